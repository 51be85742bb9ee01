"""Benchmark decontamination with suffix arrays over the training text.

Each task sorts the word suffixes of its documents (a shard of at most ``SHARD_WORDS`` words, or one longer document)
by prefix doubling, then binary-searches every suffix of every benchmark item in that array: that gives the longest
verbatim match of each item suffix, and the range of places of each window. Equal windows have one range, so that texts
and items which repeat themselves cost no more than their places. The longest match at a place of a document is found
the other way round, in a suffix array of the items. Documents never move; the benchmark travels in blocks of bounded
size, of which a task holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import kernels as K
from tesserae.llm.store import table

WINDOW = 10
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that one broadcast block holds at most (a longer item is a block of its own).
BLOCK_BYTES = 8 << 20


class Items:
    """Word hashes of a block of benchmark items; ``need``: words of the window that starts at each word, 0 where none does."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words, rows = [], [0]
        for _, _, buf, offs in K.chunks(pa.array(texts, pa.large_string())):
            w, r = K.word_hashes(buf, offs, K.ALNUM_BYTES)
            words.append(w)
            rows += (r[1:] + rows[-1]).tolist()
        self.ids, self.words, self.rows = ids, np.concatenate([*words, np.zeros(1, np.uint64)]), np.array(rows)
        size = np.diff(self.rows)
        self.item = np.repeat(np.arange(len(ids)), size)
        self.left = np.repeat(self.rows[1:], size) - np.arange(len(self.item))
        k = np.minimum(size, window)
        self.need = np.where(self.left >= k[self.item], k[self.item], 0)
        self.longest = int(size.max(initial=0))
        # the items one after the other with a zero behind each, and their suffix array
        ends = np.cumsum(size)
        self.flat = np.insert(self.words[:-1], ends, 0) if len(size) else np.zeros(0, np.uint64)
        self.flat_item = np.repeat(np.arange(len(ids)), size + 1)
        self.order = suffix_array(self.flat, self.longest + 1)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` words at least; words are compared as numbers, the end comes first."""
    n = len(words)
    order = np.argsort(words)
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    h = 1
    while h < depth:
        single = np.append(new[1:], True) & new
        at = np.flatnonzero(~single)  # only suffixes that still tie are sorted again
        if not len(at):
            break
        pos = order[at]
        head = rank[pos]
        nxt = pos + h
        tail = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = head * (n + 1) + tail
        again = np.argsort(key)
        key = key[again]
        order[at] = pos[again]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        group = np.flatnonzero(fresh)
        rank[order[at]] = np.repeat(at[group], np.diff(np.append(group, len(at))))
        h *= 2
    return order


def common(text: np.ndarray, pos: np.ndarray, words: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the suffixes of ``text`` at pos and of ``words`` at q have in common, at most ``most``."""
    out = np.zeros(len(pos), np.int64)
    live = np.flatnonzero(most > 0)
    d = 0
    while len(live):
        at = pos[live] + d
        same = (at < len(text)) & (text[np.minimum(at, len(text) - 1)] == words[q[live] + d])
        live = live[same]
        d += 1
        out[live] = d
        live = live[most[live] > d]
    return out


def search(text: np.ndarray, order: np.ndarray, words: np.ndarray, q: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """First place in ``order`` whose suffix is not below (``after``: is above) the ``length`` words of ``words`` at q."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        pos, ql, most = order[mid], q[live], length[live]
        d = common(text, pos, words, ql, most)
        whole, at = d == most, pos + d
        ended = at >= len(text)
        below = ended | (text[np.minimum(at, len(text) - 1)] < words[np.minimum(ql + d, len(words) - 1)])
        right = np.where(whole, after, below)
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)


def longest_matches(text: np.ndarray, order: np.ndarray, words: np.ndarray, q: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that ``words`` at q has in common with the suffix of ``text`` that shares the most, at most ``most``, and where that is."""
    spot = search(text, order, words, q, most, False)
    best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for near in (spot - 1, spot):
        ok = (near >= 0) & (near < len(order))
        d, at = np.zeros(len(q), np.int64), order[np.clip(near, 0, max(0, len(order) - 1))] if len(order) else near
        d[ok] = common(text, at[ok], words, q[ok], most[ok])
        where = np.where(d > best, at, where)
        best = np.maximum(best, d)
    return best, where


def window_ranges(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end place in ``order`` and words of each different window that occurs; the item and the range of each window."""
    q = np.arange(len(items.item))
    longest, _ = longest_matches(text, order, items.words, q, items.left)
    q = q[(items.need > 0) & (longest >= items.need)]
    lo, hi = (search(text, order, items.words, q, items.need[q], after) for after in (False, True))
    _, first, which = np.unique(lo * (items.longest + 1) + items.need[q], return_index=True, return_inverse=True)
    return lo[first], hi[first], items.need[q][first], items.item[q], which


def _scan(blocks: list, window: int, keep_clean: str | None = None):
    """Rows of findings; with ``keep_clean`` (the text column) instead the input's rows that nothing hits, whole."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())])

    def shard(ids: list[pa.Array], words: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        size = np.concatenate(sizes)
        n = len(size)
        starts = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + n, np.uint64)  # a zero ends each document
        doc = np.repeat(np.arange(n), size + 1)
        inner = np.ones(len(text), bool)
        inner[starts + size] = False
        text[inner] = np.concatenate(words)
        edge = np.zeros(len(text) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(n)]
        best, best_item, best_at = np.zeros(n, np.int64), np.full(n, None, object), np.zeros(n, np.int64)
        order = depth = None
        for block in blocks:
            items: Items = block.value
            if order is None or depth < items.longest:
                depth = items.longest
                order = suffix_array(text, depth) if depth else None
            if items.longest:
                lo, hi, need, item, which = window_ranges(text, order, items)
                count = hi - lo
                pos = order[np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
                of = np.repeat(np.arange(len(lo)), count)
                np.add.at(edge, pos, 1)
                np.add.at(edge, pos + need[of], -1)
                # documents of each range, and items of each range: every pair is a row of the result
                pairs = np.unique(of * n + doc[pos])
                by = np.argsort(which, kind="stable")
                named, cuts = item[by], np.searchsorted(which[by], np.arange(len(lo) + 1))
                for r, cut in zip(range(len(lo)), np.split(pairs, np.searchsorted(pairs, np.arange(1, len(lo)) * n)) if len(lo) else [], strict=True):
                    names = {items.ids[i] for i in np.unique(named[cuts[r] : cuts[r + 1]])}
                    for d in (cut - r * n).tolist():
                        found[d] |= names
                pos = np.unique(pos)
                length, where = longest_matches(items.flat, items.order, text, pos, (starts + size)[doc[pos]] - pos)
                first = np.lexsort((pos, -length, doc[pos]))
                d, at = np.unique(doc[pos][first], return_index=True)
                at = first[at]
                more = length[at] > best[d]
                d, at = d[more], at[more]
                best[d], best_at[d] = length[at], pos[at] - starts[d]
                best_item[d] = [items.ids[i] for i in items.flat_item[where[at]]]
            block.__dict__.pop("_value", None)  # a worker keeps what it has read of a broadcast otherwise
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        lists = [sorted(x) for x in found]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(size), pa.array(hit[starts + size] - hit[starts]), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, schema.field("items").type), pa.array(best), pa.array(best_item.tolist(), pa.string()), pa.array(best_at, mask=best == 0)], schema=schema
        )

    def clean(parts: list[pa.RecordBatch], words: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hit = shard([pa.nulls(sum(map(len, sizes)), pa.int64())], words, sizes).column(2)
        at = 0
        for part in parts:
            yield part.filter(pc.equal(hit.slice(at, part.num_rows), 0))
            at += part.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, held = [], [], [], 0
        for batch in batches:
            for i, j, buf, offs in K.chunks(batch.column(1) if keep_clean is None else batch.column(batch.schema.get_field_index(keep_clean))):
                w, rows = K.word_hashes(buf, offs, K.ALNUM_BYTES)
                ids.append((batch.column(0) if keep_clean is None else batch).slice(i, j - i))
                words.append(np.maximum(w, np.uint64(1)))
                sizes.append(np.diff(rows))
                held += len(w) + j - i
                if held >= SHARD_WORDS:
                    yield from [shard(ids, words, sizes)] if keep_clean is None else clean(ids, words, sizes)
                    ids, words, sizes, held = [], [], [], 0
        if ids:
            yield from [shard(ids, words, sizes)] if keep_clean is None else clean(ids, words, sizes)

    return run


def _item_blocks(tests: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """Broadcasts of the items, each of bounded size."""
    sc = tests.sparkSession.sparkContext
    out, ids, texts, held = [], [], [], 0
    for row in tests.select(F.col(id_col).cast("string"), F.col(text_col)).filter(f"{id_col} is not null and {text_col} is not null").toLocalIterator():
        if held and held + len(row[1]) * 4 > BLOCK_BYTES:
            out.append(sc.broadcast(Items(ids, texts, window)))
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1]) * 4
    return [*out, sc.broadcast(Items(ids, texts, window))] if ids else out


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit, n_items, items (ids as sorted strings), longest_match, longest_item, longest_at, contaminated.

    Words are runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. A word is hit if an occurrence of a
    window of ``window`` item words (all words of a shorter item) covers it. Null texts have no words; items without
    id or words are ignored; rows of items that share an id are one item. An empty table of either gives no hits. Of
    matches of equal length the first in the document counts as the longest. Repeated rows give equal rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = _item_blocks(tests, item_id, item_text, window)
    found = plain.mapInArrow(_scan(blocks, window), "id long, n_words long, n_hit long, n_items long, items array<string>, longest_match long, longest_item string, longest_at long")
    return found.select(F.col("id").alias(id_col), *found.columns[1:], (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no window of an item hits, with all their columns."""
    return docs.mapInArrow(_scan(_item_blocks(tests, item_id, item_text, window), window, text_col), docs.schema)


def op8_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark, with a digest of the items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
