"""Phrases whose words go together, from exact counts.

Texts become parts of bounded size, where they are read. A part sends every bucket the hashes of its words and pairs that lie in the bucket's
range, with their counts; the bucket adds them up and answers with a bit for each, set where the sum over all parts is large enough. Equal
phrases have equal hashes, so no frequent phrase is lost. A part then counts, as texts, the words and pairs that were answered so, and keeps the runs of words in which
all pairs are; the longer phrases of these runs go the same way together. The counts of texts alone, added up by bucket, decide what is frequent:
phrases are compared as texts, never by a hash. Those found are dealt out again, every part asks once for each text that a phrase of its own
can be cut into, the totals come to it, and there its phrases are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .shingles import hashes, scramble, text_chunks

#: Most words of a phrase, least count of one, and phrases returned per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text that make a part; parts that share a bucket's work, beyond the first buckets; memory of a bucket, beyond which it adds up its hashes in several passes.
PART_BYTES, SHARED, FIRST_BUCKETS, BUCKET_MEMORY = 1 << 23, 8, 32, "256MB"
#: Bytes of a hash, and bytes that adding up one takes.
HASH_BYTES, HASH_COST = 6, 64
#: Partitions of parts at most.
MOST_PARTITIONS = 2000
#: A-Z to a-z, everything that ends a piece to a line end, tabs to spaces.
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0b\x0c\x0d":
    _PLAIN[_c] = 10
_PLAIN[9] = 32
_PLAIN = bytes(_PLAIN)
_SEGMENT, _COUNT, _EXACT = range(3)
#: What parts write. Segments: lang, packed (text). Counts: packed, the hashes of one bucket and how often each occurs. Exact: packed, the keys of one bucket and how often each occurs.
STATE = "kind int, part long, lang string, bucket int, packed binary"
ANSWER, TOTAL = "part long, bucket int, mask binary", "key string, f long"
SCORED = "kind int, lang string, phrase string, a long, l long, r long, n long, score long"
_CANDIDATE, _COVERED = range(2)
_GAP = np.isin(np.arange(256), (10, 32))
_U = np.uint64
_STEP = scramble(np.arange(1, 65, dtype=np.uint64)) | _U(1)


class Part:
    """The words of a part's texts, each text of one language, with line ends between pieces and one space between words."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.raw, self.names = b"\n".join(texts), langs
        data = np.frombuffer(self.raw, dtype=np.uint8)
        gap = np.concatenate(([-1], np.flatnonzero(_GAP[data]), [len(data)])).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        full = np.diff(gap) > 1
        self.begins, self.ends = gap[:-1][full] + 1, gap[1:][full]
        self.line = np.cumsum(np.concatenate(([False], data[gap[1:-1]] == 10)), dtype=gap.dtype)[full]
        edge = np.searchsorted(self.begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.lang = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(edge))
        off = np.concatenate(([0], np.cumsum(self.ends - self.begins, dtype=np.int64)))
        words = pa.Array.from_buffers(pa.large_binary(), len(self.begins), [None, pa.py_buffer(off), pa.py_buffer(self.raw.translate(None, b" \n"))])
        codes, found, n = [np.zeros(0, dtype=gap.dtype)], [np.zeros(0, dtype=np.uint64)], 0
        for lang, x, y in zip(langs, edge[:-1].tolist(), edge[1:].tolist(), strict=True):  # the same word in two languages is two
            if y > x:
                own = words.slice(x, y - x).dictionary_encode()
                at = np.frombuffer(own.dictionary.buffers()[1], dtype=np.int64)[: len(own.dictionary) + 1]
                name = np.frombuffer(b"\n" + lang.encode(), dtype=np.uint8)
                seed = hashes(name, np.array([0]), np.array([len(name)]))
                found.append(scramble(hashes(np.frombuffer(own.dictionary.buffers()[2], dtype=np.uint8)[: at[-1]], at[:-1], at[1:]) + seed))
                codes.append(own.indices.to_numpy().astype(gap.dtype) + gap.dtype.type(n))
                n += len(own.dictionary)
        self.code, self.word = np.concatenate(codes), np.concatenate(found)
        self.hash = self.word[self.code]

    def found(self, size: int):
        """Where phrases of so many words begin, and their hashes."""
        n = max(0, len(self.code) - size + 1)
        h = _mixed([self.hash[k : k + n] for k in range(size)])
        if size == 1:
            return np.arange(n), h
        at = np.flatnonzero(self.line[:n] == self.line[size - 1 :])
        return at, h[at]

    def hashes(self, sizes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of phrases of these sizes in order, and where each begins among all of them."""
        h = np.concatenate([self.found(size)[1] for size in sizes])
        h.sort()
        first = _firsts(h)
        return h[first], np.append(first, len(h))

    def words(self, wanted: np.ndarray):
        """Hashes, keys and counts of the words with these hashes."""
        n, first = np.bincount(self.code, minlength=len(self.word)), np.flatnonzero(self.code > np.maximum.accumulate(np.concatenate(([-1], self.code)))[:-1])
        h = _mixed([self.word])
        on = np.flatnonzero(_among(h, wanted))
        return h[on], self.keys(first[on], 1), n[on]

    def counted(self, size: int, wanted: np.ndarray):
        """Where phrases of so many words with these hashes begin; their hashes, keys and counts. Equal hashes are one key, and what differs from the first phrase of its hash stands for itself."""
        at, h = self.found(size)
        on = _among(h, wanted)
        at, h = at[on], h[on]
        order = np.argsort(h)
        at, h = at[order], h[order]
        first = _firsts(h)
        many = np.diff(np.append(first, len(h)))
        head = np.repeat(at[first], many)
        same = np.ones(len(at), dtype=bool)
        for k in range(size):
            same &= self.code[at + k] == self.code[head + k]
        own = np.concatenate((first, np.flatnonzero(~same)))
        n = np.add.reduceat(same, first, dtype=np.int64) if len(first) else first
        return at, h[own], self.keys(at[own], size), np.concatenate((n, np.ones(len(own) - len(first), dtype=np.int64)))

    def keys(self, at: np.ndarray, size: int) -> list[bytes]:
        """Language, line end and text of the phrases of so many words that begin at these places."""
        heads, raw = [x.encode() + b"\n" for x in self.names], self.raw
        return [heads[g] + raw[x:y] for g, x, y in zip(self.lang[at].tolist(), self.begins[at].tolist(), self.ends[at + size - 1].tolist(), strict=True)]

    def runs(self, on: np.ndarray) -> dict[str, list[bytes]]:
        """Runs of two and more of the pairs that begin at these places, by language."""
        new = np.ones(len(on), dtype=bool)
        new[1:] = (on[1:] != on[:-1] + 1) | (self.line[on[1:]] != self.line[on[:-1]])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(on)) - 1 if len(start) else start
        long = stop > start
        x, y, found = on[start[long]], on[stop[long]] + 1, {}
        for g, a, b in zip(self.lang[x].tolist(), self.begins[x].tolist(), self.ends[y].tolist(), strict=True):
            found.setdefault(self.names[g], []).append(self.raw[a:b])
        return found


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words."""
    h = np.full(len(words[0]), len(words), dtype=np.uint64)
    for k, word in enumerate(words):
        h += word * _STEP[k]
    return scramble(h) >> _U(64 - 8 * HASH_BYTES)


def _firsts(h: np.ndarray) -> np.ndarray:
    """Where each of sorted numbers begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), h[1:] != h[:-1])))


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are among the wanted ones, which are in order: most others fall to a table of their first bits."""
    low = _U((1 << 22) - 1)
    table = np.zeros(int(low) + 1, dtype=bool)
    table[wanted & low] = True
    yes = table[h & low]
    on = np.flatnonzero(yes)
    if len(on):
        yes[on] = wanted[np.minimum(np.searchsorted(wanted, h[on]), len(wanted) - 1)] == h[on]
    return yes


def _blocks(h: np.ndarray, n: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Between edges, hashes in order and their counts as one block: steps from one to the next and counts, byte by byte of all."""
    step = np.diff(h, prepend=_U(0))
    step[edge[:-1]] = h[edge[:-1]]
    planes = [(x >> _U(8 * k)).astype(np.uint8) for x, wide in ((step, HASH_BYTES), (n.astype(np.uint64), 4)) for k in range(wide)]
    return [(y - x).to_bytes(4, "little") + zstandard.compress(b"".join(p[x:y].tobytes() for p in planes), 1) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _size(block: bytes) -> int:
    return int.from_bytes(block[:4], "little")


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(block[4:]), dtype=np.uint8).reshape(HASH_BYTES + 4, _size(block))
    added = lambda some: sum((p.astype(np.uint64) << _U(8 * k) for k, p in enumerate(some)), np.zeros(planes.shape[1], dtype=np.uint64))
    return np.cumsum(added(planes[:HASH_BYTES]), dtype=np.uint64), added(planes[HASH_BYTES:]).astype(np.uint32)


_TYPES = {"kind": pa.int32(), "part": pa.int64(), "lang": pa.string(), "bucket": pa.int32(), "packed": pa.binary()}


def _state(kind: int, part: int, rows: int, **columns) -> pa.RecordBatch:
    """Rows of STATE; columns not given are null."""
    given = {"kind": np.full(rows, kind), "part": np.full(rows, part)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[c]).cast(t) if c in given else pa.nulls(rows, t) for c, t in _TYPES.items()], names=list(_TYPES))


def _edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes begins among hashes in order, and their end."""
    return np.searchsorted(h, np.array([-(-(b << 8 * HASH_BYTES) // buckets) for b in range(buckets + 1)], dtype=np.uint64))


def _single(text: bytes) -> bytes:
    """A text with one space where there are several, so that a phrase is a slice of it."""
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _sent(part: int, texts: dict[str, list[bytes]], sizes, buckets: int):
    """A part's texts, and what it sends the buckets of their phrases."""
    joined = {lang: _single(b"\n".join(x)) for lang, x in sorted(texts.items())}
    yield _state(_SEGMENT, part, len(joined), lang=list(joined), packed=[zstandard.compress(x, 1) for x in joined.values()])
    h, first = Part(list(joined), list(joined.values())).hashes(sizes)
    edge = _edges(h, buckets)
    some = np.flatnonzero(np.diff(edge))
    yield _state(_COUNT, part, len(some), bucket=some, packed=pa.array(_blocks(h, np.diff(first), np.append(edge[some], len(h))), pa.binary()))


def _exact(part: int, counts, buckets: int) -> pa.RecordBatch:
    """What a part tells the buckets of its phrases' texts: hashes, keys and counts."""
    h, n = (np.concatenate([x[k] for x in counts]) for k in (0, 2))
    order = np.argsort(h)
    keys, n, edge = pa.array([k for x in counts for k in x[1]], pa.large_binary()).take(pa.array(order)), n[order], _edges(h[order], buckets)
    some = np.flatnonzero(np.diff(edge))
    return _state(_EXACT, part, len(some), bucket=some, packed=pa.array([_texts_packed(keys.slice(a, b - a), n[a:b]) for a, b in zip(edge[some].tolist(), edge[some + 1].tolist(), strict=True)], pa.binary()))


def _texts_packed(keys: pa.Array, n: np.ndarray) -> bytes:
    """Keys and their counts as one block."""
    at = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw = keys.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    return zstandard.compress(len(keys).to_bytes(8, "little") + n.astype("<i8").tobytes() + np.diff(at).astype("<i4").tobytes() + raw, 1)


def _texts_unpacked(block: bytes) -> pa.Table:
    block = zstandard.decompress(block)
    n = int.from_bytes(block[:8], "little")
    at = np.concatenate(([0], np.cumsum(np.frombuffer(block, dtype="<i4", count=n, offset=8 + 8 * n), dtype=np.int64)))
    return pa.table({"key": pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(block[8 + 12 * n :])]), "n": np.frombuffer(block, dtype="<i8", count=n, offset=8)})


def _shares(text: bytes, most: int):
    """A text in shares of at most so many bytes, cut between pieces; a longer piece is a share."""
    a = 0
    while len(text) - a > most:
        cut = text.rfind(b"\n", a, a + most)
        cut = cut if cut >= 0 else text.find(b"\n", a + most)
        if cut < 0:
            break
        yield text[a:cut]
        a = cut + 1
    yield text[a:]


def _begun(sizes, part_bytes: int, buckets: int):
    """Parts from rows of language and text, where these are read."""
    def run(batches):
        part, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, off, data in text_chunks(b.column(1), part_bytes):
                plain, off = data.tobytes().translate(_PLAIN), off.tolist()
                for lang, x, y in zip(langs[i : i + len(off) - 1], off[:-1], off[1:], strict=True):
                    for share in _shares(plain[x:y], part_bytes):
                        if size and size + len(share) > part_bytes:
                            yield from _sent(part, held, sizes, buckets)
                            part, held, size = part + 1, {}, 0
                        held.setdefault(lang, []).append(share)
                        size += len(share) + 1
        if held:
            yield from _sent(part, held, sizes, buckets)

    return run


def scored(key: bytes, total) -> tuple[int, int, int, int, int]:
    """a, l, r, n and score of a phrase by its weakest cut, the first of those that tie. total: key -> count."""
    head, _, phrase = key.rpartition(b"\n")
    head, words = head + b"\n", phrase.split(b" ")
    a, n, best = total(key), total(head), None
    for k in range(1, len(words)):
        left, right = total(head + b" ".join(words[:k])), total(head + b" ".join(words[k:]))
        score = 1000 * a * n // (left * right)
        if best is None or score < best[4]:
            best = (a, left, right, n, score)
    return best


def _cuts(key: bytes) -> list[bytes]:
    """Keys of all that the score of a phrase needs besides itself: its language, and both sides of every cut."""
    head, _, phrase = key.rpartition(b"\n")
    head, words = head + b"\n", phrase.split(b" ")
    return [head, *(head + b" ".join(x) for k in range(1, len(words)) for x in (words[:k], words[k:]))]


def _asked(batches):
    """What each part asks for to score its phrases."""
    for b in batches:
        part, key = [], []
        for p, k in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            cuts = _cuts(k)
            part += [p] * len(cuts)
            key += cuts
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(key, pa.binary()).cast(pa.string())], names=["part", "key"])


def _owned(own: pa.Table, totals: pa.Table) -> pa.Table:
    """A part's phrases with their scores, and the phrases one word shorter that occur nowhere else."""
    keys = own.column("key").cast(pa.binary()).to_pylist()
    known = dict(zip(totals.column("key").cast(pa.binary()).to_pylist(), totals.column("f").to_pylist(), strict=True)) | dict(zip(keys, own.column("f").to_pylist(), strict=True))
    rows = []
    for key in keys:
        head, _, phrase = key.rpartition(b"\n")
        found, words = scored(key, known.__getitem__), phrase.split(b" ")
        rows.append((_CANDIDATE, head.decode(), phrase.decode(), *found))
        if len(words) > 2:
            shorter = {b" ".join(words[:-1]), b" ".join(words[1:])}
            rows += [(_COVERED, head.decode(), x.decode(), *[None] * 5) for x in shorter if 100 * found[0] >= 100 * known[head + b"\n" + x]]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * 8
    return pa.table({c: pa.array(x, types[t]) for (c, t), x in zip((x.split() for x in SCORED.split(", ")), columns, strict=True)})


def _next(sizes, longer, buckets: int):
    """With the answers on phrases of these sizes: counts of those answered as frequent, and with longer sizes the runs of frequent pairs and what they send the buckets."""
    def run(given: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_state(_SEGMENT, 0, 0)]
        if len(given):
            part = given.column("part")[0].as_py()
            own = Part(given.column("lang").to_pylist(), [zstandard.decompress(x) for x in given.column("packed").to_pylist()])
            h, _ = own.hashes(sizes)
            edge, yes = _edges(h, buckets), np.zeros(len(h), dtype=bool)
            for b, mask in zip(answers.column("bucket").to_pylist(), answers.column("mask").to_pylist(), strict=True):
                bits = np.frombuffer(zstandard.decompress(mask), dtype=np.uint8)
                yes[edge[b] : edge[b + 1]] = np.unpackbits(bits, bitorder="little")[: edge[b + 1] - edge[b]]
            wanted, pairs, exact = h[yes], None, []
            del h, yes
            for size in sizes:
                if size == 1:  # and each language's words in all, under its key without a text
                    exact.append((np.zeros(len(own.names), dtype=np.uint64), [x.encode() + b"\n" for x in own.names], np.bincount(own.lang, minlength=len(own.names))))
                    exact.append(own.words(wanted))
                else:
                    at, *counts = own.counted(size, wanted)
                    exact.append(counts)
                    pairs = at if size == 2 else pairs
            out.append(_exact(part, exact, buckets))
            found = own.runs(np.sort(pairs)) if longer else None
            del own
            if found:
                out += _sent(part, found, longer, buckets)
        return pa.Table.from_batches(out)

    return run


def _answered(least: int, memory: str):
    """A bucket: for each part a mask of the hashes whose counts over all parts add up to least."""
    def run(given: pa.Table) -> pa.Table:
        blocks = given.column("packed").to_pylist()
        edge = np.cumsum([0, *map(_size, blocks)])
        passes = -(-int(edge[-1]) * HASH_COST // (int(memory.removesuffix("MB")) << 20)) or 1
        yes = np.zeros(edge[-1], dtype=bool)
        for p in range(passes):
            h, n, at = [], [], []
            for block, a in zip(blocks, edge.tolist()):
                x, m = _unpacked(block)
                on = np.flatnonzero(x % _U(passes) == p)
                h.append(x[on])
                n.append(m[on])
                at.append((on + a).astype(np.int32 if edge[-1] < 1 << 31 else np.int64))
            h, n, at = map(np.concatenate, (h, n, at))
            order = np.argsort(h)
            h = h[order]
            first = _firsts(h)
            if len(first):
                yes[at[order]] = np.repeat(np.add.reduceat(n[order], first, dtype=np.int64) >= least, np.diff(np.append(first, len(h))))
        masks = [zstandard.compress(np.packbits(yes[a:b], bitorder="little").tobytes(), 1) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.table({"part": given.column("part"), "bucket": given.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return run


def _added(least: int):
    """A bucket: its keys' totals over all parts, of those that reach least and of languages."""
    def run(given: pa.Table) -> pa.Table:
        table = pa.concat_tables([_texts_unpacked(x) for x in given.column("packed").to_pylist()])
        table = table.group_by("key").aggregate([("n", "sum")])
        table = table.filter(pc.or_(pc.greater_equal(table.column("n_sum"), least), pc.ends_with(table.column("key"), "\n")))
        return pa.table({"key": table.column("key").cast(pa.string()), "f": table.column("n_sum")})

    return run


def candidates(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, part_bytes: int = PART_BYTES, memory: str = BUCKET_MEMORY):
    """All phrases of 2 to longest words found least times or more in their language (lang, phrase, a, l, r, n, score), and those that occur only inside a longer one (lang, phrase)."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bytes_read = [r.size for r in given.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("size")).collect()]
    total = sum(bytes_read)
    parts = max(1, -(-total // part_bytes))
    spread, buckets = min(parts, MOST_PARTITIONS), max(min(parts, FIRST_BUCKETS), -(-parts // SHARED))
    if max(bytes_read, default=0) > max(4 * part_bytes, 2 * total // docs.sparkSession.sparkContext.defaultParallelism):  # few files, or uneven ones
        given = given.repartition(spread)
    one, more = (1, 2), tuple(range(3, longest + 1))
    state, found = materialize(given.mapInArrow(_begun(one, part_bytes, buckets), STATE), "pieces"), []
    by_bucket = lambda kind: state.where(F.col("kind") == kind).select("part", "bucket", "packed").repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket")
    for now, longer in ((one, more), (more, ())):
        if not now:
            break
        answers = materialize(by_bucket(_COUNT).applyInArrow(_answered(least, memory), ANSWER), "answers")
        segments = state.where(F.col("kind") == _SEGMENT).select("part", "lang", "packed").repartition(spread, "part")
        step = segments.groupBy("part").cogroup(answers.repartition(spread, "part").groupBy("part")).applyInArrow(_next(now, longer, buckets), STATE)
        before, state = state, materialize(step, "phrases")
        discard(before, answers)
        found.append(materialize(by_bucket(_EXACT).applyInArrow(_added(least), TOTAL), "totals"))
    discard(state)
    totals = found[0] if len(found) == 1 else found[0].union(found[1])
    phrases = F.substring_index("key", "\n", -1).contains(" ")
    owned = totals.where(phrases).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    asked = owned.select("part", "key").mapInArrow(_asked, "part long, key string").distinct()
    known = asked.join(totals.select("key", "f"), "key").select("part", "key", "f")
    done = materialize(owned.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_owned, SCORED), "scored")
    discard(*found)
    return done.where(F.col("kind") == _CANDIDATE).drop("kind"), done.where(F.col("kind") == _COVERED).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """The first top phrases of each language by score, then count, then text: lang, rank, phrase, a, l, r, n, score.

    A phrase that a longer one of the same count holds goes; it is enough to look at phrases one word longer, as counts between two equal ones are equal.

    - Null text is empty, a null language "und", an empty one a language of its own. Repeated rows count each; doc_ids play no role.
    - Texts are taken whole, at any length: a piece is never cut, so a part may be longer than part_bytes by one piece.
    - Ties of the score go by count, then by the bytes of the text, so no two phrases tie. No documents: no rows.
    - Columns other than lang and text are ignored, whatever their names.

    A phrase, language or piece with a third of all words is one row a part, and each part is one of many; the first phrases of a language are cut task by task before they meet.
    """
    found, covered = candidates(docs, longest, least, part_bytes)
    left = found.join(covered.distinct(), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
m as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w, count(*) as m from p group by 1, 2),
g as (select lang, k, array_to_string(w[i + 1 : i + k], ' ') as phrase, m from (select lang, w, m, k, unnest(range(0, len(w) - k + 1)) as i from (select *, unnest(range(1, 6)) as k from m) where k <= len(w))),
f as (select lang, k, phrase, sum(m)::bigint as f from g group by lang, k, phrase),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 100),
s as (select c.*, j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1 :], ' ') as y from (select *, unnest(range(1, k)) as j from c) c),
t as (select s.*, l.f as l, r.f as r, n.n, (1000::hugeint * a * n.n) // (l.f::hugeint * r.f) as score from s join f l on l.lang = s.lang and l.phrase = x join f r on r.lang = s.lang and r.phrase = y join n on n.lang = s.lang),
b as (select * from t qualify row_number() over (partition by lang, phrase order by score, j) = 1),
d as (select distinct lang, array_to_string(w[i + 1 : i + q], ' ') as phrase, q, a from (select *, unnest(range(0, k - q + 1)) as i from (select *, unnest(range(2, k)) as q from c where k > 2))),
kept as (select b.* from b where not exists (select 1 from d where d.lang = b.lang and d.phrase = b.phrase and 100 * d.a >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept qualify rank <= 2000"""
