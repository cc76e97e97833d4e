"""Operator 1: lines within an edit distance of each other.

Two lines may differ by one edit for each ``chars_per_edit`` code points of the
longer, and by ``edits`` at most.
A line is cut into one segment more than the threshold, so a line within the
threshold holds one of the segments unchanged, near its place.  Each line puts
its own segments into an index by length and place, and looks up its substrings
for every length from the threshold below its own, at the starts where an edit
script could leave them.  All lines that meet are compared with each other, if
their lengths and the letters that occur an odd number of times allow it; a key
of many lines is cut into blocks.  Candidates are verified by edit distance in a
diagonal band, with the differences of a column held in the bits of a long.

A segment that many unlike lines share, as the time stamps of a log, is not a
sufficient key.  Around it, of at most two edits, all are on its right (then the
left sides are equal), all on its left, or one is on each side.  So such a key is
replaced by keys with the equal side and a segment of the other, and by keys with a half
of either side; those that are still shared by many unlike lines are
replaced again.  This is done as long as such keys make more comparisons than ``COMPARED_A_ROW``
for each row of the index.  No link is lost by it, and pairs stay in proportion to the lines.

All of it is DataFrame operations.  Equal lines are one node from the start, so
copies are never paired; they are removed at any length.  Only a caller's own
``least_chars`` keeps lines below it, which match equal lines and stay.

Defined results: a null text has no lines and an empty text one blank line;
blank lines are classes of their own and stay; lines are compared without the
blanks at their ends; of a class, the line with the smallest (doc_id, line
number) stays; rows that repeat it stay too; rows without doc_id link with
nothing.  ``n_links`` counts the different lines within the threshold of a line.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_ROWS, free_names, small_side, staged


#: Rows of a key that are compared with all its others in one place.
BLOCK_ROWS = 512
#: A key of more rows than this is replaced where fewer than this part of them could be within reach of its first one.
HOT_ROWS, LIKE_PART = 64, 0.5
#: What tells of two lines that they cannot link, before their texts are compared.
SIGNS = ("size", "parity", "pairs")
#: How often keys are replaced at most; what is left is compared in blocks.
HOT_ROUNDS = 5
#: Comparisons of signs under such keys for each row of the index; as long as there are no more, no key is replaced.
COMPARED_A_ROW = 64


class EditJoin(NamedTuple):
    """Lines of ``least_chars`` code points or more link within ``edits`` insertions, deletions and substitutions.

    Fewer are allowed where the longer line has less than ``chars_per_edit`` code points (3 at least) for each.  With
    ``same_digits``, lines whose runs of digits differ do not link.
    """

    edits: int = 2
    least_chars: int = 1
    chars_per_edit: int = 6
    same_digits: bool = False


def allowed(size: Column, how: EditJoin) -> Column:
    """The threshold where the longer line has ``size`` code points."""
    return F.least(F.lit(how.edits), F.floor(size / how.chars_per_edit)).cast("int")


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\v\f"))


def node_of(line: Column) -> Column:
    """The name of a line without the blanks at its ends."""
    return F.xxhash64(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, size, node) of every line; ``node`` names the line without the blanks at its ends."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    split = split.select("doc_id", "line_no", stripped(F.col("raw")).alias("line"))
    return split.select("doc_id", "line_no", "line", F.length("line").alias("size"), node_of(F.col("line")).alias("node"))


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift): where a line looks for the segments of one that is ``shorter`` by so much.

    The first is the line's own segment where neither length nor place differ.
    """
    k = edits
    return [(s, i, t) for s in range(k + 1) for i in range(k + 1) for t in range(max(-i, s - (k - i)), min(i, s + (k - i)) + 1)]


def index_rows(lines: DataFrame, how: EditJoin) -> DataFrame:
    """(key, node, indexed, ...): the line's own segments, and the substrings under which it looks for others.

    ``level`` is the threshold, ``at`` and ``chars`` are the substring's place, ``shorter`` and ``shift`` say by how much the line and what stands
    before the substring are longer than those of the line that is looked for.  The segments of a length are equal parts, the longer ones last; a line looks for those of its own threshold, and
    indexes those of each threshold that a longer line may have.  One row of the plan's constants is
    made for each probe first, so the generated code stays small enough to be compiled.
    """
    names = ("level", "shorter", "part", "shift")
    rounds = [(k, *p) for k in range(1, how.edits + 1) for p in probes(k)]
    constant = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p, strict=True))) for p in rounds))
    long = lines.filter((F.col("size") >= how.least_chars) & F.col("doc_id").isNotNull())
    # a line of single-byte symbols is cut by bytes, which need not be counted from its start; the hash is of bytes either way
    plain = F.when(F.octet_length("line") == F.col("size"), F.col("line").cast("binary"))
    long = long.select("node", "line", "size", plain.alias("plain"))
    rows = long.select("node", "line", "plain", "size", F.inline(constant)).withColumn("length", F.col("size") - F.col("shorter"))
    own = (F.col("shorter") == 0) & (F.col("shift") == 0)
    level, least = F.col("level"), allowed(F.col("size"), how)
    rows = rows.filter((level == least) | (own & (level > least) & (level <= allowed(F.col("size") + level, how))))
    base, long_from = F.floor(F.col("length") / (level + 1)).cast("int"), level + 1 - F.col("length") % (level + 1)
    rows = rows.withColumn("at", base * F.col("part") + F.greatest(F.lit(0), F.col("part") - long_from) + F.col("shift"))
    rows = rows.withColumn("chars", base + F.when(F.col("part") >= long_from, 1).otherwise(0))
    rows = rows.filter((F.col("length") >= how.least_chars) & (F.col("at") >= 0) & (F.col("at") + F.col("chars") <= F.col("size")))
    first, chars = F.col("at") + 1, F.col("chars")
    by_bytes, by_symbols = (F.xxhash64("level", "length", "part", F.substring(F.col(c), first, chars)) for c in ("plain", "line"))
    key = F.when(F.col("plain").isNotNull(), by_bytes).otherwise(by_symbols)
    return rows.select(key.alias("key"), "node", own.alias("indexed"), "level", "line", "at", "chars", "shorter", "shift")


def _segment(size: Column, parts: Column, part: Column) -> tuple[Column, Column]:
    """Start and length of one of ``parts`` equal segments, the longer ones last."""
    base, long_from = F.floor(size / parts).cast("int"), parts - size % parts
    return base * part + F.greatest(F.lit(0), part - long_from), base + F.when(part >= long_from, 1).otherwise(0)


def narrowed(rows: DataFrame) -> DataFrame:
    """Rows (key, node, indexed, level, line, at, chars, shorter, shift) of keys that are replaced, as rows of the new keys.

    ``level`` is 1 or 2.  A row with an equal side goes on with the other side as its ``line``; one of a half of either side is
    ``last``, with hashes of both sides, which must differ.
    """
    left, right = F.substring(F.col("line"), F.lit(1), F.col("at")), F.substring(F.col("line"), F.col("at") + F.col("chars") + 1, F.length("line"))
    rows = rows.withColumns({"left": left, "right": right, "d_left": F.col("shift"), "d_right": F.col("shorter") - F.col("shift")})
    rows = rows.withColumns({"n_left": F.length("left") - F.col("d_left"), "n_right": F.length("right") - F.col("d_right")})
    # one side is equal: the other is searched for a segment, as a whole line is
    steps = [(side, k, j, t) for side in (0, 1) for k in (1, 2) for j in range(k + 1) for t in range(-j, j + 1)]
    constant = lambda names, values: F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, x, strict=True))) for x in values)))
    one = rows.select("*", constant(("side", "k", "part", "t"), steps)).filter("k = level")
    pick = lambda a, b: F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b))
    one = one.withColumns({"same": pick("left", "right"), "other": pick("right", "left"), "d": pick("d_right", "d_left"), "n": pick("n_right", "n_left"), "d_same": pick("d_left", "d_right")})
    one = one.filter("d_same = 0 and n >= 0 and abs(d - t) <= level - part")
    start, chars = _segment(F.col("n"), F.col("level") + 1, F.col("part"))
    one = one.withColumns({"start": (start + F.col("t")).cast("int"), "long": chars.cast("int")}).filter("start >= 0 and start + long <= length(other)")
    key = F.xxhash64("key", "side", "part", "same", F.substring(F.col("other"), F.col("start") + 1, F.col("long")))
    none = F.lit(None).cast("long")
    one = one.select(
        key.alias("key"), "node", (F.col("indexed") & (F.col("t") == 0)).alias("indexed"), "level", F.col("other").alias("line"), F.col("start").alias("at"),
        F.col("long").alias("chars"), F.col("d").alias("shorter"), F.col("t").alias("shift"), F.lit(False).alias("last"), none.alias("of_left"), none.alias("of_right"),
    )
    # one edit is on each side: a half of either is unchanged
    both = rows.filter("level = 2 and abs(d_left) <= 1 and abs(d_right) <= 1 and (n_left > 0 or d_left <> 0) and (n_right > 0 or d_right <> 0) and n_left >= 0 and n_right >= 0")
    both = both.select("*", constant(("l", "r"), [(0, 0), (0, 1), (1, 0), (1, 1)]))
    for side, half in (("left", "l"), ("right", "r")):
        start, chars = _segment(F.col(f"n_{side}"), F.lit(2), F.col(half))
        both = both.withColumns({f"s_{half}": (start + F.col(half) * F.col(f"d_{side}")).cast("int"), f"c_{half}": chars.cast("int")})
        both = both.filter(f"s_{half} >= 0 and s_{half} + c_{half} <= length({side})").withColumn(f"h_{half}", F.substring(F.col(side), F.col(f"s_{half}") + 1, F.col(f"c_{half}")))
    both = both.select(
        F.xxhash64("key", F.lit(2), "l", "r", "h_l", "h_r").alias("key"), "node", "indexed", "level", F.lit("").alias("line"), F.lit(0).alias("at"), F.lit(0).alias("chars"),
        "shorter", "shift", F.lit(True).alias("last"), F.xxhash64("left").alias("of_left"), F.xxhash64("right").alias("of_right"),
    )
    return one.union(both)


def _odd(hashes: Column) -> Column:
    """63 bits: those that an odd number of ``hashes`` set."""
    def flip(bits: Column, value: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(63)).cast("int")))

    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def letter_parity(line: Column) -> Column:
    """Bits of the letters that occur an odd number of times; an edit changes two of them at most."""
    return _odd(F.transform(F.split(line, ""), lambda letter: F.xxhash64(letter)))


def pair_parity(line: Column) -> Column:
    """Bits of the neighbouring letters that occur an odd number of times, the last one's neighbour being the end; an edit changes four at most.

    Lines of one origin with a few words replaced have nearly the same letters, but not the same neighbours.
    """
    letters = F.split(line, "")
    return _odd(F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))


def edit_distance(rows: Column, columns: Column, edits: int) -> Column:
    """The edit distance of two arrays of ``edits`` symbols or more; some number above ``edits`` if it is larger.

    The arrays are columns of a table: an expression would be evaluated again for each symbol.

    Column by column of the distance matrix, over a band of 2 * ``edits`` + 1 diagonals.  Bit t of a long
    stands for the row that is t - ``edits`` below the diagonal: ``up`` has the rows whose distance is one more than
    that of the row above, ``down`` those with one less.  The distance is followed along the lowest
    diagonal of the band, and along the last row once that is reached.
    """
    width = 2 * edits + 1
    whole = (1 << width) - 1
    lit = lambda v: F.lit(v).cast("long")
    n = F.size(rows)

    def equal(j: Column) -> Column:
        """Which rows of the band have the symbol of column j."""
        bits = lit(0)
        for t in range(width):
            bits = bits.bitwiseOR(F.when(F.get(rows, j - edits + t - 1) == F.get(columns, j - 1), lit(1 << t)).otherwise(lit(0)))
        return bits

    def step(held: Column, column: Column) -> Column:
        same, up, down = column["same"], held["up"], held["down"]
        diagonal = (same.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down).bitwiseAND(lit(whole))

        def last(d: Column) -> Column:
            right = down.bitwiseOR(F.bitwise_not(d.bitwiseOR(up)).bitwiseAND(lit(whole)))
            left = d.bitwiseAND(up)

            def moved(rl: Column) -> Column:
                below = F.shiftright(d, 1)
                at = F.least(lit(2 * edits), (n - column["j"] + edits).cast("long")).cast("int")
                bit = lambda x: F.call_function("shiftright", x, at).bitwiseAND(lit(1))
                along = F.when(column["j"] <= n - edits, 1 - bit(d)).otherwise(bit(rl["r"]) - bit(rl["l"]))
                return F.struct(
                    rl["l"].bitwiseOR(F.bitwise_not(below.bitwiseOR(rl["r"])).bitwiseAND(lit(whole))).alias("up"),
                    below.bitwiseAND(rl["r"]).alias("down"),
                    (held["distance"] + along).cast("long").alias("distance"),
                )

            return F.get(F.transform(F.array(F.struct(right.alias("r"), left.alias("l"))), moved), F.lit(0))

        return F.get(F.transform(F.array(diagonal), last), F.lit(0))

    start = F.struct(lit((1 << (edits + 1)) - 1 << edits).alias("up"), lit(0).alias("down"), lit(edits).alias("distance"))
    steps = F.transform(F.sequence(F.lit(1), F.size(columns)), lambda j: F.struct(j.alias("j"), equal(j).alias("same")))
    near = F.abs(n - F.size(columns)) <= edits
    return F.when(near, F.aggregate(steps, start, step, lambda held: held["distance"])).otherwise(lit(edits + 1))


def _without_common_start(rows: DataFrame, keep: int) -> DataFrame:
    """``rows`` with most of what line_a and line_b begin with alike cut off; ``keep`` code points of each stay at least."""
    room = F.least(F.length("line_a"), F.length("line_b")) - keep

    def longer(cut: Column, step: Column) -> Column:
        alike = F.substring(F.col("line_a"), cut + 1, step) == F.substring(F.col("line_b"), cut + 1, step)
        return F.when((cut + step <= room) & alike, cut + step).otherwise(cut)

    rows = rows.withColumn("cut", F.aggregate(F.array(*(F.lit(1 << n) for n in range(12, -1, -1))), F.lit(0), longer))
    return rows.withColumns({name: F.substring(name, F.col("cut") + 1, F.length(name)) for name in ("line_a", "line_b")}).drop("cut")


def may_link(a: Column, b: Column, how: EditJoin) -> Column:
    """Whether lengths, odd letters and odd neighbours of two rows (size, parity, pairs) leave a link possible."""
    most = allowed(F.greatest(a["size"], b["size"]), how)
    odd = lambda c: F.bit_count(a[c].bitwiseXOR(b[c]))
    return (F.abs(a["size"] - b["size"]) <= most) & (odd("parity") <= 2 * most) & (odd("pairs") <= 4 * most)


def middle_may_match(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines that differ in their first and in their last symbol can be within one or two edits.

    An edit falls on each end then, and all between is shifted by one place at most.
    """
    size = F.length(a) - 2
    alike = [F.substring(b, F.lit(2 + shift), size) == F.substring(a, F.lit(2), size) for shift in (-1, 0, 1)]
    differ = (F.substring(a, 1, 1) != F.substring(b, 1, 1)) & (F.substring(a, -1, 1) != F.substring(b, -1, 1))
    return F.lit(edits > 2) | ~differ | (size < 4) | alike[0] | alike[1] | alike[2]


def verified(pairs: DataFrame, texts: DataFrame, how: EditJoin) -> DataFrame:
    """The pairs (a, b) within the threshold; ``texts`` is (node, line, size, parity, pairs).

    What two lines have in common at their ends is cut off first, which leaves their distance as it is.
    """
    rows = pairs.select("a", "b")
    for name in "ab":
        rows = rows.join(texts.select(F.col("node").alias(name), F.struct(*SIGNS).alias(f"sign_{name}"), F.col("line").alias(f"line_{name}")), name)
    rows = rows.filter(may_link(F.col("sign_a"), F.col("sign_b"), how))
    if how.same_digits:
        digits = lambda c: F.regexp_replace(c, "[^0-9]+", " ")
        rows = rows.filter(digits("line_a") == digits("line_b"))
    rows = rows.withColumn("most", allowed(F.greatest("sign_a.size", "sign_b.size"), how)).drop("sign_a", "sign_b")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _without_common_start(rows, how.edits).withColumns({"line_a": F.reverse("line_a"), "line_b": F.reverse("line_b")})
    rows = staged(_without_common_start(rows, how.edits), "line-middles")
    rows = rows.filter(middle_may_match(F.col("line_a"), F.col("line_b"), how.edits))
    symbols = rows.select("a", "b", "most", F.split("line_a", "").alias("rows"), F.split("line_b", "").alias("columns"))
    rows = staged(symbols.repartition(tasks, "a", "b"), "line-candidates")  # few bytes, but much work each
    near = edit_distance(F.col("rows"), F.col("columns"), how.edits) <= F.col("most")
    return staged(rows.filter(near).select("a", "b"), "line-links")


def _signed(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members (key, node, indexed, last, met) with the signs of their lines; a stored table."""
    return staged(members.join(texts.select("node", *SIGNS), "node"), "line-signed")


def _large_keys(signed: DataFrame, how: EditJoin) -> DataFrame:
    """(key, rows, like, last) of the keys of many lines: how many, and which part of them could link with the first of them; a stored table.

    ``met`` counts copies too, so only keys that many rows met are looked at.
    """
    many = signed.filter(F.col("met") > HOT_ROWS)
    heads = many.groupBy("key").agg(F.min_by(F.struct(*SIGNS), "node").alias("head"), F.count("*").alias("rows")).filter(F.col("rows") > HOT_ROWS)
    near = may_link({c: F.col(f"head.{c}") for c in SIGNS}, {c: F.col(c) for c in SIGNS}, how)
    parts = many.join(heads, "key").groupBy("key").agg(F.first("rows").alias("rows"), F.avg(near.cast("int")).alias("like"), F.max("last").alias("last"))
    return staged(parts, "line-large-keys")


def _counted(signed: DataFrame, large: DataFrame) -> DataFrame:
    """Signed rows with the ``rows`` of large keys, null for others."""
    sizes = small_side(large.filter(F.col("rows") > BLOCK_ROWS).select("key", "rows"))
    return signed.select("key", "node", "indexed", *SIGNS).join(sizes, "key", "left")


def candidates(lines: DataFrame, how: EditJoin) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that may link, once each, and the texts (node, line, size, parity, pairs) of all nodes that met; stored tables."""
    rows = index_rows(lines, how)
    met = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("indexed").alias("any"), F.count("*").alias("met"))
    met = small_side(staged(met.filter("low <> high and any").select("key", "met"), "line-keys"))
    members = rows.join(met, "key").groupBy("key", "node").agg(F.max("indexed").alias("indexed"), F.lit(False).alias("last"), F.first("met").alias("met"))
    members = staged(members, "line-members")

    nodes = small_side(staged(members.select("node").distinct(), "line-nodes"))
    texts = lines.filter(F.col("size") >= how.least_chars).select("node", "line").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    texts = staged(texts.select("node", "line", F.length("line").alias("size"), letter_parity(F.col("line")).alias("parity"), pair_parity(F.col("line")).alias("pairs")), "line-texts")

    signed = _signed(members, texts)
    large = _large_keys(signed, how)
    most, settled = COMPARED_A_ROW * signed.count(), []
    for _ in range(HOT_ROUNDS if how.edits <= 2 else 0):
        hot = large.filter((F.col("like") < LIKE_PART) & ~F.col("last"))
        n_hot, compared = hot.agg(F.count("*"), F.coalesce(F.sum(F.col("rows") * (F.col("rows") - 1) / 2), F.lit(0.0))).first()
        if compared <= most:
            break
        hot = hot.select("key")
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        settled.append(_counted(signed.join(side, "key", "left_anti"), large))
        # every place at which a line meets the others; a line that repeats is one node, so it is taken once
        place = ["key", "node", "indexed", "level", "line", "at", "chars", "shorter", "shift"]
        met_there = staged(rows.select(*place).join(side, "key", "left_semi").dropDuplicates([c for c in place if c != "line"]), "line-hot-rows")
        narrow = staged(narrowed(met_there), "line-narrow-all")
        apart = F.max("last") & ((F.min("of_left") == F.max("of_left")) | (F.min("of_right") == F.max("of_right")))
        met = narrow.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("indexed").alias("any"), apart.alias("one_side"), F.count("*").alias("met"))
        met = small_side(staged(met.filter("low <> high and any and not coalesce(one_side, false)").select("key", "met"), "line-keys"))
        rows = staged(narrow.join(met, "key"), "line-narrow")
        members = rows.groupBy("key", "node").agg(F.max("indexed").alias("indexed"), F.max("last").alias("last"), F.first("met").alias("met"))
        signed = _signed(members, texts)
        large = _large_keys(signed, how)
    signed = _counted(signed, large)
    for part in settled:
        signed = signed.union(part)

    # a key of many lines is dealt out: each indexed line to one block, the lines that look it up to all
    signed = signed.withColumn("blocks", F.ceil(F.coalesce("rows", F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int"))
    dealt = {"left": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "right": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}
    side = lambda rows, x, end: rows.select("key", dealt[end].alias("block"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "indexed", *SIGNS)))
    left, right = side(signed.filter("indexed"), "a", "left"), side(signed, "b", "right")
    sign = lambda x: {c: F.col(f"{c}_{x}") for c in SIGNS}
    once = (F.col("node_a") < F.col("node_b")) | (~F.col("indexed_b") & (F.col("node_a") != F.col("node_b")))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & once & may_link(sign("a"), sign("b"), how))
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    return staged(pairs, "line-pairs"), texts


def line_links(docs: DataFrame, how: EditJoin) -> DataFrame:
    """Every link (a, b) of the edit join between distinct nodes, once each."""
    pairs, texts = candidates(lines_of(docs), how)
    return verified(pairs, texts, how)


def line_classes(docs: DataFrame, how: EditJoin = EditJoin()) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, n_links, kept) of every line: its class is named by its first line."""
    return named_lines(docs, how).drop("node")


def named_lines(docs: DataFrame, how: EditJoin) -> DataFrame:
    """``line_classes`` with the node of each line."""
    docs = docs.select("doc_id", "text")
    links = line_links(docs, how)
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    grouped = components(links).join(degrees, "node").withColumnRenamed("node", "of_node")
    grouped = small_side(staged(grouped, "line-components"))
    rows = lines_of(docs).select("doc_id", "line_no", "node", "size").join(grouped, F.col("node") == F.col("of_node"), "left")
    named = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    rows = rows.select("doc_id", "line_no", "size", "node", named.alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = staged(rows, "line-rows")
    firsts = rows.filter("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    firsts = small_side(staged(firsts.filter("n > 1").select(F.col("class").alias("of_class"), "first.*").withColumnsRenamed({"doc_id": "class_doc", "line_no": "class_line"}), "line-firsts"))
    joined = rows.join(firsts, F.col("class") == F.col("of_class"), "left")
    own = F.col("class_doc").isNull() | ((F.col("class_doc") == F.col("doc_id")) & (F.col("class_line") == F.col("line_no")))
    return joined.select(
        "doc_id", "line_no", F.coalesce("class_doc", "doc_id").alias("class_doc"), F.coalesce("class_line", "line_no").alias("class_line"),
        "n_links", "node", (own | (F.col("size") < how.least_chars)).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, how: EditJoin = EditJoin()) -> DataFrame:
    """``docs`` with repeated lines taken out; documents of which no lettered line is left go. All columns stay."""
    of_doc, gone, lines = free_names(docs, "of_doc", "gone", "lines")
    removed = named_lines(docs, how).filter(~F.col("kept")).groupBy(F.col("doc_id").alias(of_doc)).agg(F.collect_set(F.struct("line_no", "node")).alias(gone))
    joined = docs.join(removed, F.col("doc_id") == F.col(of_doc), "left")
    # exploding one array makes the lines a column, so that they are split once and not for each line that stays
    joined = joined.withColumn(lines, F.explode(F.array(F.when(F.col(gone).isNotNull(), F.split("text", "\n")))))
    # a doc_id may stand for several texts: a line goes where it is the one that was named
    here = F.filter(gone, lambda g: node_of(stripped(F.get(lines, g["line_no"]))) == g["node"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(here, lambda g: g["line_no"]))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    joined = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    kept = joined.filter(F.col(gone).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(*docs.columns)
