"""SentencePiece encoding and decoding for merge-type (BPE) models, exact.

A sequence of tokens is the model's encoding of a text exactly if each token encodes to itself and each two
neighbours, re-merged from their characters, come out as the same two: a merge across a border would have shown in
the pair. So encoding is a search: Aho-Corasick matching finds the longest token from each place, the shorter ones that
start there are its own beginnings; the longest is tried first, a neighbour check admits it, and a place from which
nothing fits is marked in a bitfield and never entered again, since the encoding of each prefix is unique. That is
linear in the text, with no merging over it.

Texts are cut where no merge can reach across, which is read off the vocabulary when the model is loaded: before
space marks if no piece holds one after another character, around line feeds if no piece holds one, and before a
sign that no piece holds after a letter. Equal chunks share one search through a bounded memo. Decoding takes every id of a
text anew and never looks at the text.

Cases: null and empty texts give no ids and an empty decoded text; null in an id list decodes to nothing; a null id
list decodes to an empty text; texts of any length are encoded whole; repeated rows each give a row; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import table, tidy

MARK = "▁"
#: Chunks that a worker remembers (with a quarter as many again of pairs of tokens, and a tenth of chunks with unknown characters), and the longest that it keeps; both only bound memory.
MEMO, MEMO_CHARS = 240_000, 40
ROWS_AT_ONCE = 500


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """One model: encode(text) -> ids as int32 bytes, decode(ids) -> text."""

    def __init__(self, proto: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.silent = [sp.is_control(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        parts = dict(_fields(proto))
        trainer, rules = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if trainer.get(3, 1) != 2 or any(sp.is_unused(i) for i in range(n)) or 4 in {dict(_fields(p)).get(3, 1) for k, p in _fields(proto) if k == 1}:
            raise ValueError("only merge-type models without user-defined or unused pieces are supported")
        self.prefix, identity = bool(rules.get(3, 1)), not rules.get(2) and not rules.get(4, 1) and bool(rules.get(5, 1))
        self.normal: Callable[[str], str] | None = None if identity else sentencepiece.SentencePieceNormalizer(model_proto=proto).normalize
        plain = [i for i in range(n) if not self.silent[i] and i != self.unknown and i not in self.byte]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.size = [len(t) for t in self.text]
        self.search = ahocorasick.Automaton()
        for i in plain:
            if self.merged(self.text[i]) == [self.text[i]]:
                self.search.add_word(self.text[i], i)
        self.search.make_automaton()
        fine = {self.text[i]: i for i in self.search.values()}
        self.shorter = [-1] * n  # of a token the longest that it begins with
        for t, i in fine.items():
            self.shorter[i] = next((fine[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in fine), -1)
        self.known = {t for t in self.id if len(t) == 1}
        self.chunks = self.cutter()
        self.shown = ["" if self.silent[i] else " ⁇ " if i == self.unknown else self.text[i].replace(MARK, " ") for i in range(n)]
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the memo until it was full; what is asked for again goes on to the next
        self.odd: dict[str, bytes] = {}

    def cutter(self) -> Callable[[str], list[str]]:
        """Cuts a text where no piece, so no merge, holds the two characters side by side."""
        after: dict[str, set[str]] = {}
        for t in self.id:
            for a, b in zip(t, t[1:], strict=False):
                after.setdefault(b, set()).add(a)
        if after.get(MARK, set()) - {MARK}:
            return lambda t: [t]
        signs = {c for c in self.known if c.isascii() and not c.isalpha()}
        while bad := {c for c in signs if after.get(c, set()) - signs - {MARK}}:
            signs -= bad
        line = "" if any("\n" in t for t in self.id) else "\n"
        sign = "".join(map(re.escape, sorted(signs)))
        own = f"[{sign}]*" if sign else ""
        ways = [f"{MARK}*{own}[^{MARK}{line}{sign}]+", f"{MARK}*[{sign}]+" if sign else "", f"{MARK}+", line]
        return re.compile("|".join(w for w in ways if w)).findall

    def merged(self, text: str) -> list[str]:
        """The pieces that the model's merges make of a short text: best score first, then leftmost."""
        parts, score, none = list(text), self.score.get, -float("inf")
        found = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := max(found)) > none:
            k = found.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(found):
                found[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def together(self, a: int, b: int) -> bool:
        """Whether the two tokens come out again when their texts are merged anew."""
        key = a * len(self.text) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 5 * MEMO // 4:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return found

    def search_ids(self, text: str) -> list[int]:
        """The encoding of a text whose characters are all pieces."""
        known, width = self.pairs.get, len(self.text)
        longest = [token for _, token in self.search.iter_long(text)]  # if all neighbours fit, the search would never turn back
        for k, (a, b) in enumerate(zip(longest, longest[1:], strict=False)):
            fits = known(a * width + b)
            if not fits and (fits is not None or not self.together(a, b)):
                break
        else:
            return longest
        n, size, shorter, long = len(text), self.size, self.shorter, self.search.iter_long
        out, token = longest[: k + 1], longest[k + 1]
        at = sum([size[i] for i in out])
        failed = bytearray(n // 8 + 1)
        coming, drawn = iter(()), -1  # the longest tokens from a place on, as long as they are taken
        while True:
            end = at + size[token]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and out:
                fits = known(out[-1] * width + token)
                if fits is None:
                    fits = self.together(out[-1], token)
            if fits:
                out.append(token)
                at = end
                if at == n:
                    return out
                if token != drawn:  # a shorter one
                    coming = long(text, at)
                token = drawn = next(coming)[1]
                continue
            token = shorter[token]
            while token < 0:
                if not out:
                    raise ValueError(f"no encoding of {text[:80]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last]
                token, drawn = shorter[last], -1

    def chunk_ids(self, text: str) -> list[int]:
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:  # it merges with nothing
                out += self.search_ids(text[start:k]) if k > start else []
                out += [self.of_byte[b] for b in c.encode()] if self.of_byte else [self.unknown]
                start = k + 1
        return out + (self.search_ids(text[start:]) if start < len(text) else [])

    def learned(self, chunk: str) -> bytes:
        """A chunk's ids as int32 bytes."""
        ids = self.memo.get(chunk)
        if ids is not None:
            return ids
        ids = self.before.get(chunk)
        if ids is None and self.known.issuperset(chunk):
            ids = array("i", self.search_ids(chunk)).tobytes()
        if ids is not None:
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO // 2:
                    self.before, self.memo = self.memo, {}
                self.memo[chunk] = ids
            return ids
        found = self.odd.get(chunk)
        if found is None:
            found = array("i", self.chunk_ids(chunk)).tobytes()
            if len(chunk) <= MEMO_CHARS:
                if len(self.odd) >= MEMO // 10:
                    self.odd.clear()
                self.odd[chunk] = found
        return found

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.normal:
            return self.chunks(self.normal(text))
        return self.chunks(MARK * self.prefix + text.replace(" ", MARK))

    def inner(self, ids: list[int]) -> str:
        if self.byte.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out: list[str] = []
        pending = bytearray()

        def flush() -> None:
            rest = bytes(pending)
            pending.clear()
            while rest:
                try:
                    out.append(rest.decode())
                    return
                except UnicodeDecodeError as e:
                    out.append(rest[: e.start].decode() + "�")
                    rest = rest[e.start + 1 :]

        for i in ids:
            if i in self.byte:
                pending.append(self.byte[i])
                continue
            if pending:
                flush()
            out.append(self.shown[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.inner(ids)
        first = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if self.prefix and first is not None and self.text[first].startswith(MARK) else text

    def roundtrip(self, text: str) -> tuple[bytes, str]:
        """The ids as int32 bytes, and the text that they decode to."""
        chunks = self.cut(text)
        found = list(map(self.memo.get, chunks))
        if None in found:
            found = [self.learned(chunks[k]) if ids is None else ids for k, ids in enumerate(found)]
        ids = b"".join(found)
        return ids, self.decode(array("i", ids).tolist())


_loaded: dict[bytes, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    if proto not in _loaded:
        _loaded.clear()
        _loaded[proto] = PieceModel(proto)
    return _loaded[proto]


def _int_lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_decode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids (array of int) and decoded, the text that the ids stand for; model: path of the model file on the driver."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(proto.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                found = [m.roundtrip(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), _int_lists([x[0] for x in found]), pa.array([x[1] for x in found], pa.string())], names=[id, "ids", "decoded"])

    schema = T.StructType([docs.schema[id], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(id, text).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id and decoded of rows that have lists of ids."""
    spark = rows.sparkSession
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(proto.value)
        for batch in batches:
            texts = [m.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "decoded"])

    return rows.select(id, ids).mapInArrow(run, T.StructType([rows.schema[id], T.StructField("decoded", T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def with_digests(encoded: DataFrame) -> DataFrame:
    """What encode_decode() returns, with n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    })


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(encode_decode(table(spark, sf_dir, "documents"), model_path())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
