"""Operator 8: exact BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word at most one vocabulary token can end its encoding.
An automaton over the vocabulary names, after each symbol, every token that is
a suffix of the prefix; a token is the last one if the prefix before it ends
with a token next to which it can stand.  That token is stored with the prefix,
and following the stored tokens back from the end of the word emits the ids.

The texts are split and encoded in Arrow batches on the executors.  A worker
keeps the encodings of the words that it has met, up to a fixed number of bytes.
Texts of code points that older versions of Unicode have are normalised and
split here; whether others are letters differs between tables, so texts that
hold any of those are normalised and split by the tokenizer's library.

Defined results: a null text counts as empty; an empty text has no ids, the
digests of the empty string, and 0 tokens; repeated rows and equal texts each
give a row; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_batches

#: Bytes that a worker spends on remembered words, and on pairs of tokens whose compatibility it knows.  At half of them the newer half
#: becomes the older one, which is forgotten then but for what was looked up meanwhile.
REMEMBERED_WORD_BYTES, REMEMBERED_PAIR_BYTES = 64 << 20, 16 << 20
#: Longer words are encoded anew each time.
REMEMBERED_SYMBOLS = 64
#: Bytes of a dictionary's entry, and of one whose key is a number.
_ENTRY, _NUMBER_ENTRY = 160, 136
#: A vocabulary file above this size is not sent to the executors.
VOCABULARY_BYTES = 64 << 20
#: Texts in an Arrow batch; long texts make large batches.
BATCH_ROWS = 500

_WORD_END = "</w>"
#: The private-use range holds the 256 symbols that end a word.
_END_BASE = 0xF0000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A word-level BPE vocabulary: ``encode`` gives the ids of a text, ``tokens`` their strings."""

    def __init__(self, spec: bytes):
        import ahocorasick
        import regex

        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        named = vocab | self.special
        self.strings: list[str | None] = [None] * (max(named.values()) + 1)
        for s, i in named.items():
            self.strings[i] = s
        if not all("<|" in s for s in self.special):
            raise ValueError("special tokens are looked for in texts with <| only")
        self._special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        #: The words of this vocabulary's pre-tokeniser.
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self._bytes = dict(enumerate(byte_symbols()))
        self._spec, self._library = {k: model[k] for k in ("version", "normalizer", "pre_tokenizer")}, None
        self._checked: set[str] = set()  # code points that need no library
        self._next = len(self.strings)
        self._rank: dict[int, int] = {}  # by left * _next + right
        self._left, self._right, self._made = (array("i", [-1]) * self._next for _ in range(3))
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self._rank[a * self._next + b] = rank
            if self._made[whole] < 0:
                self._left[whole], self._right[whole], self._made[whole] = a, b, rank
        self._usable: dict[int, bool] = {}
        self._size = array("i", [0]) * self._next
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in vocab.items():
            if self._whole(i):
                key = self._symbols(s)
                self._size[i] = len(key)
                self._automaton.add_word(key, i)
        self._automaton.make_automaton()
        self._usable.clear()
        self._pairs, self._older_pairs = {}, {}  # by left * _next + right
        self._known, self._older = {}, {}
        self._known_bytes = 0

    @staticmethod
    def _symbols(token: str) -> str:
        """One character per symbol; the symbol that ends a word is another than the same byte inside it."""
        if token.endswith(_WORD_END) and len(token) > len(_WORD_END):
            return token[: -len(_WORD_END) - 1] + chr(_END_BASE + ord(token[-len(_WORD_END) - 1]))
        return token

    def _side_by_side(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge (of a rank below ``before``) joins the end of ``left`` with the start of ``right``.

        Walks back in time over the tokens that touched at the border: the younger of the two is taken
        apart, and the pair of each moment must not have been due for merging while both were there.
        """
        due_left = due_right = before if before is not None else 1 << 60
        while True:
            rank = self._rank.get(left * self._next + right)
            if rank is not None and rank < due_left and rank <= due_right and (before is None or rank < before):
                return False
            age_left, age_right = self._made[left], self._made[right]
            if age_left < 0 and age_right < 0:
                return True
            if age_left > age_right:
                due_left, left = age_left, self._right[left]
            else:
                due_right, right = age_right, self._left[right]

    def _whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self._usable.get(token)
        if known is None:
            left, right = self._left[token], self._right[token]
            known = left < 0 or (self._whole(left) and self._whole(right) and self._side_by_side(left, right, before=self._made[token]))
            self._usable[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        symbols = word.encode("utf-8").decode("latin-1").translate(self._bytes)
        symbols = symbols[:-1] + chr(_END_BASE + ord(symbols[-1]))
        tokens, starts = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)  # per prefix: its last token and where that begins
        for end, token in self._automaton.iter(symbols):
            end += 1
            start = end - self._size[token]
            if tokens[end] >= 0:
                continue
            if start:
                before = tokens[start]
                if before < 0:
                    continue
                pair = before * self._next + token
                fits = self._pairs.get(pair)
                if fits is None:
                    if 2 * len(self._pairs) * _NUMBER_ENTRY >= REMEMBERED_PAIR_BYTES:
                        self._pairs, self._older_pairs = {}, self._pairs
                    fits = self._older_pairs.get(pair)
                    fits = self._pairs[pair] = self._side_by_side(before, token) if fits is None else fits
                if not fits:
                    continue
            tokens[end], starts[end] = token, start
        ids, at = [], len(symbols)
        while at:
            ids.append(tokens[at])
            at = starts[at]
        return ids[::-1]

    def _learn(self, word: str) -> tuple[str, str]:
        found = self._older.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = " ".join(map(str, ids)), " ".join(self.strings[i] for i in ids)
        if len(word) <= REMEMBERED_SYMBOLS:
            size = _ENTRY + sys.getsizeof(word) + sys.getsizeof(found[0]) + sys.getsizeof(found[1])
            if 2 * (self._known_bytes + size) > REMEMBERED_WORD_BYTES:
                self._known, self._older, self._known_bytes = {}, self._known, 0
            self._known[word] = found
            self._known_bytes += size
        return found

    def _split_by_library(self, piece: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            steps = self._spec["pre_tokenizer"]["pretokenizers"]
            splits = {"type": "Sequence", "pretokenizers": [x for x in steps if x["type"] != "ByteLevel"]}
            model = {"type": "BPE", "vocab": {}, "merges": []}
            self._library = Tokenizer.from_str(json.dumps(self._spec | {"pre_tokenizer": splits, "model": model}))
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))]

    def _words(self, piece: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if not piece.isascii():
            if new := set(piece) - self._checked:
                if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in new):
                    return self._split_by_library(piece)
                self._checked |= new
            piece = unicodedata.normalize("NFC", piece)
        return self._split.findall("".join(map(str.lower, piece)) if "Σ" in piece else piece.lower())  # no rule for a final sigma

    def _entries(self, text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for piece in self._special_split.split(text) if "<|" in text else [text]:
            if piece in self.special:
                out.append((str(self.special[piece]), piece))
            else:
                for w in self._words(piece):
                    out.append(self._known.get(w) or self._learn(w))
        return out

    def encoded(self, text: str) -> tuple[int, str, str]:
        """The number of tokens, the ids joined by a space, and the decoded text."""
        entries = self._entries(text)
        if not entries:
            return 0, "", ""
        ids = " ".join([e[0] for e in entries])
        return ids.count(" ") + 1, ids, " ".join([e[1] for e in entries])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a space, special tokens included; unknown ids are left out."""
        known = (self.strings[i] for i in ids if 0 <= i < self._next)
        return " ".join(s for s in known if s is not None)


_loaded: dict[bytes, WordBPE] = {}


def loaded(spec: bytes) -> WordBPE:
    """The vocabulary, built once in each worker process; the words it remembers serve later tasks too."""
    key = hashlib.sha256(spec).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBPE(spec)
    return _loaded[key]


def vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes; fails for a file too large to be sent to every executor."""
    spec = Path(path).read_bytes()
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(spec)} bytes; at most {VOCABULARY_BYTES} are broadcast")
    return spec


def _mapped(docs: DataFrame, path: str, row: Callable[[WordBPE, str], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """``docs`` (doc_id, text) as rows of doc_id and what ``row`` gives for the text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = [row(bpe, t.as_py() or "") for t in part.column(1)]
                columns = [part.column(0), *(pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), list(arrow)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return in_batches(docs.select("doc_id", "text"), run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _mapped(docs, path, lambda bpe, t: (bpe.encode(t),), "doc_id long, ids array<int>", arrow)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], schema=arrow)

    return in_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""

    def row(bpe: WordBPE, text: str) -> tuple[int, str, str]:
        n, ids, decoded = bpe.encoded(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, path, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow)
