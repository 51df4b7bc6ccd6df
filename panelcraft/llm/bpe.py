"""BPE encoding by backtracking over longest token matches, and decoding from a table of pieces.

A word is a sequence of symbols: one per byte, the last one marked as word end. An Aho-Corasick automaton over
the vocabulary gives, for every end position, the tokens that end there, longest first. Two neighbouring tokens are compatible if merging their joined symbols gives back
the same two tokens. The exact merges of a word are the only chain of tokens with all neighbours compatible;
the encoder walks from the left, keeps the longest compatible token that ends at each position, and so finds it
in time linear in the word's length (tokens that end at a position are few and bounded by the longest token).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import small

#: Words remembered per worker before the cache starts anew.
CACHE_WORDS = 300_000
#: Entries of the compatibility table kept per worker before it starts anew.
COMPATIBLE_PAIRS = 1_000_000
WORD_END = "</w>"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeVocabulary:
    """Vocabulary, merges, pre-tokenizer pattern and special tokens of a tokenizer file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model.get("end_of_word_suffix") != WORD_END or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a tokenizer of the word-end kind")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", UNICODE_SPACE_IN_SET))
        self.letters_stay_whole = split.startswith(LETTERS_FIRST)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        bytes_of = byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        self.symbols: dict[int, str] = {}
        pieces: dict[int, bytes] = {}
        for token, i in vocab.items():
            end = token.endswith(WORD_END) and token != WORD_END
            raw = bytes(bytes_of[c] for c in (token.removesuffix(WORD_END) if end else token))
            # inside the encoder, symbol 0-255 is a byte and 256-511 a byte that ends its word
            self.symbols[i] = raw.decode("latin-1")[:-1] + chr(raw[-1] + 256 * end)
            pieces[i] = token.encode("utf-8")
        pieces |= {i: s.encode("utf-8") for s, i in self.special.items()}
        self.ids = {s: i for i, s in self.symbols.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = rank
            self.parts.setdefault(whole, (vocab[left], vocab[right]))
        self.single = {i for i, s in self.symbols.items() if len(s) == 1}
        top = max(pieces) + 1
        self.pieces = [pieces.get(i, b"") for i in range(top)]
        self.decimals = [str(i) for i in range(top)]


#: The white space class of the tokenizer's own regex engine.
UNICODE_SPACE_IN_SET = r"\t\n\v\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A pattern that begins so takes a run of letters as one pre-token.
LETTERS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|"
_ASCII_SPACE, _CONTROL = re.compile(r"[\t\n\v\f\r ]+"), re.compile(r"[\x1c-\x1f]")


def lower_each(text: str) -> str:
    """Lower-case character by character, without regard to the neighbours."""
    low = text.lower()
    return low if "Σ" not in text else "".join("σ" if c == "Σ" else c.lower() for c in text)


class BacktrackingEncoder:
    """Exact BPE of single words, with a cache of bounded size."""

    def __init__(self, vocabulary: BpeVocabulary) -> None:
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        for symbols, i in vocabulary.ids.items():
            if self._reachable(i):
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.cache: dict[str, bytes] = {}

    def _seam_holds(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the seam between tokens a and b.

        Undo merges from the seam outwards: a merge across the seam that comes before the merge that closed the
        token on either side would have happened first, so the two can't both stand. Among equal merges the
        leftmost goes first.
        """
        rank, parts, single = self.v.rank, self.v.parts, self.v.single
        while True:
            across = rank.get((a, b))
            if across is not None and across < limit:
                return False
            ra = -1 if a in single else rank[parts[a]]
            rb = -1 if b in single else rank[parts[b]]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def _agree(self, left: int, right: int) -> bool:
        """Entry of the pair-compatibility table, worked out when first met."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= COMPATIBLE_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._seam_holds(left, right, len(self.v.rank))
        return known

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        known = self.own.get(token)
        if known is None:
            if token in self.v.single:
                known = True
            elif token not in self.v.parts:
                known = False
            else:
                a, b = self.v.parts[token]
                known = self._reachable(a) and self._reachable(b) and self._seam_holds(a, b, self.v.rank[a, b])
            self.own[token] = known
        return known

    def word(self, symbols: str) -> list[int]:
        """Token ids of one word given as symbols.

        The automaton reports matches by end position, the longest first; the first that is compatible with the
        token before it is the last token of the prefix that ends there.
        """
        whole = self.v.ids.get(symbols)
        if whole is not None and self._reachable(whole):
            return [whole]
        n = len(symbols)
        last, size, known = [-1] * n, [0] * n, self.compatible
        for at, (token, length) in self.automaton.iter(symbols):
            if last[at] >= 0:
                continue
            start = at - length
            if start >= 0:
                fits = known.get((last[start], token))
                if not (self._agree(last[start], token) if fits is None else fits):
                    continue
            last[at], size[at] = token, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def __call__(self, word: str) -> bytes:
        """Ids of a pre-token, packed as uint32."""
        raw = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        ids = self.word(raw[:-1] + chr(ord(raw[-1]) + 256))
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        found = self.cache[word] = array("I", ids).tobytes()
        return found


class BpeTokenizer(dict):
    """Whole texts: special tokens, normalisation, pre-tokens, encoder and decoder. Remembers chunks it has met."""

    def __init__(self, vocabulary: BpeVocabulary) -> None:
        super().__init__()
        self.v, self.encoder = vocabulary, BacktrackingEncoder(vocabulary)

    def words(self, text: str) -> list[str]:
        """Pre-tokens. White space is never part of one, so runs of it need no replacing."""
        low = text.lower() if text.isascii() else lower_each(unicodedata.normalize("NFC", text))
        return [low] if self.v.letters_stay_whole and low.isalpha() else self.v.pattern.findall(low)

    def __missing__(self, chunk: str) -> bytes:
        cache, encoder = self.encoder.cache, self.encoder
        parts = [cache.get(w) or encoder(w) for w in self.words(chunk)]
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[chunk] = parts[0] if len(parts) == 1 else b"".join(parts)
        return found

    def _chunks(self, text: str) -> list[str]:
        """The text cut at white space, where neither normalisation nor pre-tokens reach across.

        Python also cuts at four control signs that the tokenizer does not take for white space.
        """
        return _ASCII_SPACE.split(text) if _CONTROL.search(text) else text.split()

    def _parts(self, text: str) -> Iterator[bytes]:
        at = 0
        for m in self.v.special_pattern.finditer(text):
            yield from map(self.__getitem__, self._chunks(text[at : m.start()]))
            yield array("I", [self.v.special[m.group()]]).tobytes()
            at = m.end()
        yield from map(self.__getitem__, self._chunks(text[at:]))

    def ids(self, text: str | None) -> list[int]:
        """Token ids of a whole text. Null counts as empty."""
        text = text or ""
        parts = self._parts(text) if any(s in text for s in self.v.special) else map(self.__getitem__, self._chunks(text))
        return array("I", b"".join(parts)).tolist()

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.v.decimals.__getitem__, ids))

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimal text joined by spaces."""
        ids = self.ids(text)
        return np.array(ids, np.uint32), self.decimal(ids)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The pieces of the ids, one space between them."""
        return b" ".join(map(self.v.pieces.__getitem__, ids))


_LOADED: dict[str, BpeTokenizer] = {}


def tokenizer(path: str) -> BpeTokenizer:
    """The tokenizer of a file, built once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = BpeTokenizer(BpeVocabulary(path))
    return _LOADED[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    for batch in small(batches):
        ids, decoded = [], []
        for text in batch.column(1).to_pylist():
            found = own.ids(text)
            ids.append(np.array(found, np.int32))
            decoded.append(own.decode(found).decode("utf-8", "replace"))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
        yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row: token ids of the whole text, and the text they decode to.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat are encoded one by one;
    other columns are not read. The vocabulary is read on the executors from ``path``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>, decoded string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    for batch in small(batches):
        n, a, b = [], [], []
        for text in batch.column(1).to_pylist():
            ids = own.ids(text)
            n.append(len(ids))
            a.append(hashlib.sha256(own.decimal(ids).encode("ascii")).hexdigest())
            b.append(hashlib.sha256(own.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and SHA-256 of ids and decoded text, without sending the ids back to the JVM."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_digest, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: id, number of tokens, ids and decoded text of each document."""
    return encode(docs, vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


@query("op10_bpe_encode_decode")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())
