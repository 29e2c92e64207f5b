"""Byte-pair encoding of whole texts with a public byte-level vocabulary, and back.

Texts are split into words by the vocabulary's pattern. The words a worker hasn't met yet are encoded together by one
recursive query in DuckDB: token-position rows are joined with the merge table, in each step every word contracts its
pair of least rank (leftmost first; where the same pair occurs again in the word, there too, which is what the next
steps would do, as a new token's own merges all have higher ranks), and a word leaves the recursion when no pair of it
can be merged. Decoding joins token positions with the vocabulary and aggregates the bytes in order.

A word of ``LONG_WORD`` bytes or more (rows of one letter, scans of rules) doesn't go through the query, which keeps every
step of every word: its pairs wait in a heap. The ids are the same.

Nothing is shuffled: each task reads its texts and returns their ids. What a worker keeps is bounded by parameters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The byte-level pattern that both public byte-level vocabularies are used with: contractions, words, numbers, other signs, blanks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that one recursive query encodes, their bytes, and words that a worker remembers.
QUERY_WORDS, QUERY_BYTES, KEPT_WORDS = 30_000, 400_000, 300_000
#: Bytes of a word from which it is merged by itself: the recursive query keeps every step of a word, so its cost grows
#: with the square of the length.
LONG_WORD = 600
#: Texts and characters that are handled at once.
TEXTS, CHARACTERS = 500, 2_000_000


def folder(spark: SparkSession) -> str:
    """The folder of the vocabularies: ``spanlake.tokenizers`` of the session, else the usual place."""
    return spark.conf.get("spanlake.tokenizers", TOKENIZERS)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id and the merges ``(left id, right id, rank, new id)`` of one vocabulary file."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
            letters = _byte_letters()
            ids = model["vocab"]
            self.tokens = {i: bytes(letters[c] for c in s) for s, i in ids.items() if all(c in letters for c in s)}
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            self.merges = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
        else:
            import base64

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            self.tokens = {i: t for t, i in ranks.items()}
            self.merges = [(*self._halves(t, i, ranks), i, i) for t, i in ranks.items() if len(t) > 1]
        self.byte_ids = {t[0]: i for i, t in self.tokens.items() if len(t) == 1}

    @staticmethod
    def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: what lower ranks make of its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60) if parts[i] + parts[i + 1] != token else 1 << 60)
            if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                raise ValueError(f"no merge makes {token!r}")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return ranks[parts[0]], ranks[parts[1]]


_ENCODE = """
WITH RECURSIVE step(word, pos, id, live) AS (
  SELECT word, pos, id, true FROM bytes_of
  UNION ALL
  (WITH pair AS (
     SELECT word, pos, id, lead(id) OVER w AS following FROM step WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)),
   ranked AS (
     SELECT p.word, p.pos, p.id, m.rank, m.made FROM pair p LEFT JOIN merges m ON m.a = p.id AND m.b = p.following),
   least AS (SELECT word, min(rank) AS best FROM ranked GROUP BY word),
   hit AS (
     SELECT r.word, r.pos, r.id, r.made, l.best IS NOT NULL AS live, coalesce(r.rank = l.best, false) AS hit,
       row_number() OVER (PARTITION BY r.word ORDER BY r.pos) AS n
     FROM ranked r JOIN least l ON l.word = r.word),
   streak AS (
     SELECT *, n - max(CASE WHEN NOT hit THEN n ELSE 0 END) OVER (PARTITION BY word ORDER BY n ROWS UNBOUNDED PRECEDING) AS nth FROM hit),
   chosen AS (
     SELECT *, hit AND nth % 2 = 1 AS take, coalesce(lag(hit AND nth % 2 = 1) OVER (PARTITION BY word ORDER BY n), false) AS gone FROM streak)
   SELECT word, pos, CASE WHEN take THEN made ELSE id END, live FROM chosen WHERE NOT gone))
SELECT word, list(id ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word
"""
_DECODE = "SELECT row, list(token ORDER BY pos) AS parts FROM ids JOIN vocabulary USING (id) GROUP BY row"


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str):
        import duckdb
        import regex

        v = Vocabulary(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, rank, made = (pa.array(c, pa.int32()) for c in zip(*v.merges, strict=True))
        self.con.register("m", pa.table({"a": a, "b": b, "rank": rank, "made": made}))
        self.con.register("t", pa.table({"id": pa.array(v.tokens.keys(), pa.int32()), "token": pa.array(v.tokens.values(), pa.binary())}))
        self.con.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM t")
        self.bytes = np.array([v.byte_ids[b] for b in range(256)], np.int32)
        self.split: Callable[[str], list[str]] = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.ranks: dict[tuple[int, int], tuple[int, int]] | None = None

    def learn(self, words: Iterator[str]) -> dict[str, np.ndarray]:
        """The ids of distinct words, by the recursive query over blocks of them."""
        short = []
        for w in words:
            if len(w) * 4 >= LONG_WORD and len(raw := w.encode("utf-8", "surrogatepass")) >= LONG_WORD:
                self.known[w] = self.merged([int(self.bytes[b]) for b in raw])
            else:
                short.append(w)
        words = iter(short)
        while block := list(islice(words, QUERY_WORDS)):
            raw = [w.encode("utf-8", "surrogatepass") for w in block]
            at = 0
            while at < len(raw):
                upto, size = at, 0
                while upto < len(raw) and (upto == at or size + len(raw[upto]) <= QUERY_BYTES):
                    size += len(raw[upto])
                    upto += 1
                lengths = np.array([len(r) for r in raw[at:upto]])
                word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                pos = np.arange(lengths.sum(), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
                ids = self.bytes[np.frombuffer(b"".join(raw[at:upto]), np.uint8)]
                self.con.register("bytes_of", pa.table({"word": word, "pos": pos, "id": ids}))
                got = self.con.sql(_ENCODE).to_arrow_table()
                self.con.unregister("bytes_of")
                for w, own in zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True):
                    self.known[block[at + w]] = own
                at = upto

    def merged(self, ids: list[int]) -> list[int]:
        """The ids of one long word: pairs wait in a heap by rank and place, neighbours in lists, so it takes n log n steps."""
        if self.ranks is None:
            a, b, rank, made = (c.to_pylist() for c in self.con.sql("SELECT a, b, rank, made FROM merges").to_arrow_table().columns)
            self.ranks = dict(zip(zip(a, b, strict=True), zip(rank, made, strict=True), strict=True))
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = [(ranks[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapify(waiting)
        while waiting:
            _, i, pair = heappop(waiting)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:  # one of them is merged already
                continue
            ids[i], ids[j] = ranks[pair][1], -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in ranks:
                    heappush(waiting, (ranks[p][0], left, p))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        words = [self.split(t) if t else () for t in texts]
        fresh = set(chain.from_iterable(words)).difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
            fresh = set(chain.from_iterable(words))
        self.learn(fresh)
        known = self.known
        coded = [[known[w] for w in own] for own in words]
        counts = np.fromiter((sum(map(len, own)) for own in coded), np.int64, len(texts))
        return np.fromiter(chain.from_iterable(chain.from_iterable(coded)), np.int32, int(counts.sum())), counts

    def decode(self, lists: pa.Array) -> list[str]:
        """The text of each list of ids; a null or an empty list is the empty text."""
        counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        self.con.register("ids", pa.table({"row": row, "pos": np.arange(len(row)), "id": lists.flatten().cast(pa.int32())}))
        out = [""] * len(lists)
        for r, parts in self.con.sql(_DECODE).fetchall():
            out[r] = b"".join(parts).decode("utf-8", "replace")
        self.con.unregister("ids")
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder of a vocabulary; workers are reused, so it outlives a task."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Blocks of at most ``TEXTS`` texts and about ``CHARACTERS`` characters."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and upto - at < TEXTS and (upto == at or size < CHARACTERS):
                size += len(texts[upto] or "")
                upto += 1
            yield batch.slice(at, upto - at), texts[at:upto]
            at = upto


def encode(documents: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each document, without special tokens.

    A null or empty text gives an empty list; a repeated row gives a repeated row; a null ``doc_id`` stays null; special
    tokens' strings in a text are ordinary text. Other columns are dropped first. Whole texts are encoded.
    """
    path = f"{tokenizers or folder(documents.sparkSession)}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches, "text"):
            ids, counts = coder(path).encode(texts)
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.record_batch([block.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``n_tokens`` (int) of each document; cases as in ``encode``."""
    path = f"{tokenizers or folder(documents.sparkSession)}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _blocks(batches, "text"):
            yield pa.record_batch([block.column("doc_id"), pa.array(coder(path).encode(texts)[1].astype(np.int32))], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens int")


def decode(encoded: DataFrame, tokenizers: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``text`` of each row of ``doc_id``, ``ids``; null or empty ids give the empty text, unknown ids nothing."""
    path = f"{tokenizers or folder(encoded.sparkSession)}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                block = whole.slice(at, TEXTS)
                yield pa.record_batch([block.column("doc_id"), pa.array(coder(path).decode(block.column("ids")), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
