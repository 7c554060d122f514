"""Encoding to and decoding from pieces of a merge vocabulary (byte-pair encoding of characters with byte fallback), as one pass with a table.

A sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding of theirs. So every prefix of a text has one
last piece: the one piece that ends there, as an automaton over all pieces finds it, and is compatible with the last piece of the prefix that it leaves.
The table of last pieces is filled from the left in one pass, and the ids are read from it backwards.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The mark that stands for a space.
MARK = "▁"
#: Texts are cut where no piece reaches across; the ids of so many cut pieces of at most so many characters are kept by a worker.
KEPT, KEPT_CHARS = 300_000, 48
#: A model larger than this is not sent to tasks.
MOST_BYTES = 1 << 26
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_INF = float("inf")

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class Merges:
    """The vocabulary of a model: encoding, decoding and the test of neighbours."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        plain = {p.type for p in proto.pieces} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        if proto.trainer_spec.model_type != 2 or not plain or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge vocabulary of normal, control and byte pieces is needed, over texts that are not rewritten and begin with a space")
        self.id, self.rank, self.piece, self.raw, self.control = {}, {}, [], [], set()
        self.bytes = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(proto.pieces):
            self.piece.append(p.piece)
            raw = p.piece.replace(MARK, " ").encode()
            if p.type == _NORMAL:
                self.id[p.piece], self.rank[p.piece] = i, -p.score
            elif p.type == _BYTE:
                raw = bytes([int(p.piece[1:-1], 16)])
                self.bytes[raw[0]] = i
            elif p.type == _CONTROL:
                raw = b""
                self.control.add(i)
            else:
                raw = " ⁇ ".encode()  # what an unknown piece reads as
            self.raw.append(raw)
        self.begin, self.end = self.piece.index("<s>"), self.piece.index("</s>")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        inside = {c for p in self.id if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if c != 32 and chr(c) not in inside)
        # Nothing reaches over a character that no longer piece has, nor, where marks only begin pieces, into a space.
        rest = "" if any(MARK in p.lstrip(MARK) for p in self.id) else " "
        self.cut = re.compile(f" *[^{rest}{alone}]+|[{alone}]| +" if rest else f"[^{alone}]+|[{alone}]", re.S)
        self.histories: dict[int, list | None] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def history(self, i: int):
        """How piece i comes about when it stands alone: (rank of the next merge, first part, last part) before each merge and at the end; none if merging its characters gives something else."""
        if i not in self.histories:
            parts, steps = list(self.piece[i]), []
            while len(parts) > 1:
                best, at = min(((self.rank.get(parts[k] + parts[k + 1], _INF), k) for k in range(len(parts) - 1)))
                if best == _INF:
                    break
                steps.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((_INF, parts[0], parts[-1]))
            self.histories[i] = steps if len(parts) == 1 else None
        return self.histories[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b are what their joined text is merged to. Both come about side by side, by the better merge first and the left one on a tie, and at no time may the merge across them be the better one. a = -1: nothing before."""
        key = a * len(self.piece) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        right = self.history(b)
        if a < 0:
            return right is not None
        left = self.history(a)
        if right is None or left is None:
            return False
        i = j = 0
        while True:
            (rank_a, _, last), (rank_b, first, _) = left[i], right[j]
            across = self.rank.get(last + first, _INF)
            if across < rank_a and across <= rank_b and across < _INF:
                return False
            if rank_a == rank_b == _INF:
                return True
            if rank_a <= rank_b:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[int]:
        """The last piece of the encoding of each prefix of text, whose spaces are marks; -1 where it ends in a character that is no piece."""
        last = [-1] * len(text)
        filled, compatible = -1, self.compatible
        for end, (i, size) in self.automaton.iter(text):
            if end == filled:
                continue
            before = end - size
            if compatible(last[before] if before >= 0 else -1, i):
                last[end], filled = i, end
        return last

    def part(self, text: str) -> np.ndarray:
        """Ids of a text whose spaces are marks, read backwards from its table."""
        last, ids, at = self.table(text), [], len(text) - 1
        while at >= 0:
            i = last[at]
            if i < 0:
                ids += self.bytes[list(text[at].encode())][::-1].tolist()
                at -= 1
            else:
                ids.append(i)
                at -= len(self.piece[i])
        return np.array(ids[::-1], dtype="<u4")

    def encode(self, text: str) -> bytes:
        """The ids of a whole text with begin and end, as little-endian 32-bit integers."""
        out = [self.begin.to_bytes(4, "little")]
        if text:
            kept = self.kept
            for part in self.cut.findall(" " + text.replace(MARK, " ")):
                ids = kept.get(part)
                if ids is None:
                    ids = self.part(part.replace(" ", MARK)).tobytes()
                    if len(part) <= KEPT_CHARS:
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[part] = ids
                out.append(ids)
        out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8: marks are spaces again, the one before the first piece goes, control pieces read as nothing, bytes that are no UTF-8 as U+FFFD each."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and self.piece[first].startswith(MARK):
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "each-byte").encode()


@lru_cache(maxsize=2)
def _merges(model: bytes) -> Merges:
    return Merges(model)


def _sent(df: DataFrame, path: str):
    """The model, read where the driver runs, for every task: its size is checked."""
    with open(path, "rb") as f:
        model = f.read(MOST_BYTES + 1)
    if len(model) > MOST_BYTES:
        raise ValueError(f"{path}: more than {MOST_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(model)


def _lists(encoded: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in encoded), dtype=np.int64, count=len(encoded))
    values = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"))
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), values)


def _mapped(batches, rows: int, work):
    """work(the last column as a list) for runs of so many rows; its columns take that column's place."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            some = b.slice(a, rows)
            more = work(some.column(some.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], *more.values()], names=[*some.schema.names[:-1], *more])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every document, begin and end included. Null text is empty."""
    model, kind = _sent(docs, path), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = _merges(model.value)
        return _mapped(batches, 256, lambda texts: {"ids": _lists([m.encode(t or "") for t in texts])})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of every row of doc_id and ids. Null ids give an empty text."""
    model, kind = _sent(encoded, path), encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = _merges(model.value)
        return _mapped(batches, 256, lambda ids: {"text": pa.array([m.decode(x or []).decode() for x in ids], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 and decoded_sha256, from encode() and decode() of every whole text.

    - Null and empty texts encode to begin and end alone, and decode to nothing. Texts of any length are taken whole.
    - Repeated rows and equal doc_ids each give a row, a null doc_id too. No documents: no rows. Other columns are ignored, whatever their names.
    - Characters outside the vocabulary, tabs and line ends among them, become bytes; the mark itself in a text reads as a space afterwards, as in the original.

    Tasks work on their rows alone, without a shuffle; what a worker keeps (ids of parts, tests of neighbours) is bounded and changes no result.
    """
    model, kind = _sent(docs, path), docs.schema["doc_id"].dataType.simpleString()

    def both(m: Merges, texts: list):
        n, of_ids, of_text = [], [], []
        for t in texts:
            raw = m.encode(t or "")
            n.append(len(raw) // 4)
            of_ids.append(hashlib.sha256(raw).hexdigest())
            of_text.append(hashlib.sha256(m.decode(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}

    def run(batches):
        m = _merges(model.value)
        return _mapped(batches, 256, lambda texts: both(m, texts))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").select("doc_id", "n_tokens", F.col("ids_sha256"), F.col("decoded_sha256"))
