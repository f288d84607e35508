"""Evaluation texts that leak into training text.

Method: short n-grams of the test items are seeds; a document that holds enough seeds of an item,
at least one of them rare in the corpus, is joined to that item; the pair is aligned word by
word (Smith-Waterman), which scores paraphrased or edited copies; and the exact share of the
item's words that stand in common stretches of eight words or more is taken. A pair is a leak if
it is aligned over more than ``ALIGNED_SHARE`` of the item or has more than the asked-for share in
such stretches.

Seeds lose no such copy: seeds that many items or documents share join a pair only beside others,
but where an item's shared seeds alone could make up the share, all its seeds count.

Scale: one pass over the texts a block of items, no shuffle of texts. The items are a stated query
set; they are taken in blocks of bounded size, each broadcast as flat arrays. Per partition only
counts of seeds (at most one row per seed) and found pairs leave the Python workers. Candidate
pairs are bounded by the seeds that documents really share with items, not by documents x items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import cut, spread

#: Words of a seed, and of the shortest word-for-word stretch.
SEED, N = 5, 8
#: Characters of item text in one broadcast block (about 120 MB in the driver and each worker).
BLOCK_CHARS = 20_000_000
#: A seed is rare if at most so many documents hold it, and own if at most so many items do.
RARE_DOCUMENTS, OWN_ITEMS = 1_000, 20
#: Seeds must cover this share of an item's words before it is aligned.
SEEDED_SHARE = 1 / 6
#: An alignment of more than this share of a whole copy's score is a leak.
ALIGNED_SHARE = 0.4

_MARKUP = re.compile(r"</?[a-z!?][^<>]*+>|&(?:#x?[0-9a-f]++|[a-z][a-z0-9]*+);|[*_`~]+", re.I)
_IN_NUMBER = re.compile(r"(?<=\d),(?=\d)")
_APOSTROPHE = re.compile(r"(?<=\w)['’](?=\w)")
_WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1

PAIR_SCHEMA = "doc_id long, item_id long, item_words int, covered_words int, coverage double, stretches int, seeded_words int, alignment_score int, alignment_share double, item_no int, seeds array<int>, seed int, n long"
PAIR_COLUMNS = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]


def words(text: str) -> list[str]:
    """Words whatever their case, punctuation, blanks, line marks or mark-up."""
    s = _MARKUP.sub(" ", text) if any(c in text for c in "<&*_`~") else text
    s = s.casefold()
    if "," in s:
        s = _IN_NUMBER.sub("", s)
    if "'" in s or "’" in s:
        s = _APOSTROPHE.sub("", s)
    return _WORD.findall(s)


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(N)], dtype=np.uint64)


def gram_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit code of the n-gram at each position (ids start at 1; 0, a word of no item, gives code 0)."""
    size = ids.size - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    x = ids.astype(np.uint64)
    x ^= x << np.uint64(17)
    codes = (x[:size]) * _POWERS[0]
    for k in range(1, n):
        codes += (x[k : size + k] + np.uint64(k)) * _POWERS[k]
    if not ids.all():
        strange = np.cumsum(np.r_[0, ids == 0])
        codes[strange[n:] != strange[:-n]] = 0
    return codes


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that starts at one of ``starts``."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


@dataclass
class ItemIndex:
    """Vocabulary, word ids and seeds of a block of items, in flat arrays."""

    vocabulary: dict[str, int]
    item_ids: np.ndarray
    ids: np.ndarray  # word ids of all items
    at: np.ndarray  # where each item's words start in ``ids``
    seed_codes: np.ndarray  # sorted
    post_at: np.ndarray  # where each seed's items start in ``post_items``
    post_items: np.ndarray
    need: np.ndarray  # seeds of an item that must be met at least
    seed: np.ndarray  # seed numbers of all items, by place
    seed_at: np.ndarray  # where each item's seeds start in ``seed``

    @classmethod
    def of(cls, items, share: float = 1 / 3) -> ItemIndex:
        """``items``: pairs of an id and a text."""
        vocabulary: dict[str, int] = {}
        item_ids, parts = [], []
        for item_id, text in items:
            parts.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text)], dtype=np.int32))
            item_ids.append(item_id)
        size = np.array([p.size for p in parts], dtype=np.int64)
        at = np.r_[0, np.cumsum(size)].astype(np.int64)
        codes = [gram_codes(p, SEED) for p in parts]
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [c.size for c in codes])
        code = np.concatenate([*codes, np.empty(0, dtype=np.uint64)])
        seed_codes, seed = np.unique(code, return_inverse=True)
        pairs = np.unique(seed.astype(np.int64) * max(1, len(parts)) + owner)
        of_seed, of_item = pairs // max(1, len(parts)), (pairs % max(1, len(parts))).astype(np.int32)
        shared = np.bincount(of_seed, minlength=seed_codes.size) > OWN_ITEMS
        ix = cls(vocabulary, np.array(item_ids, dtype=np.int64), np.concatenate([*parts, np.empty(0, dtype=np.int32)]), at, seed_codes, np.empty(0), np.empty(0), np.empty(0), seed.astype(np.int32), np.r_[0, np.cumsum([c.size for c in codes])].astype(np.int64))
        held = ix.words_in(shared)
        whole = held > share * size  # an item that shared seeds alone could give away
        kept = ~shared[of_seed] | whole[of_item]
        ix.post_items = of_item[kept]
        ix.post_at = np.r_[0, np.cumsum(np.bincount(of_seed[kept], minlength=seed_codes.size))].astype(np.int64)
        ix.need = np.maximum(1, np.ceil((SEEDED_SHARE * size - np.where(whole, 0, held)) / SEED)).astype(np.int64)
        return ix

    def item(self, i: int) -> np.ndarray:
        return self.ids[self.at[i] : self.at[i + 1]]

    def seeds_of(self, i: int) -> np.ndarray:
        """Numbers of the item's seeds, by place."""
        return self.seed[self.seed_at[i] : self.seed_at[i + 1]]

    def words_in(self, marked: np.ndarray) -> np.ndarray:
        """Words of each item that lie in seeds of the marked kind."""
        return np.array([covered(np.flatnonzero(marked[self.seeds_of(i)]), int(self.at[i + 1] - self.at[i]), SEED).sum() for i in range(self.item_ids.size)], dtype=np.int64)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.int32)
        return ids, gram_codes(ids, SEED)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the seeds that stand in a document."""
        if not self.seed_codes.size or not codes.size:
            return np.empty(0, dtype=np.int64)
        live = np.unique(codes)
        at = np.minimum(np.searchsorted(self.seed_codes, live), self.seed_codes.size - 1)
        return at[(self.seed_codes[at] == live) & (live != 0)]

    def candidates(self, seeds: np.ndarray) -> np.ndarray:
        """Numbers of the items of which a document with these seeds may hold enough."""
        first, n = self.post_at[seeds], self.post_at[seeds + 1] - self.post_at[seeds]
        if not n.sum():
            return np.empty(0, dtype=np.int64)
        place = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, met = np.unique(self.post_items[place], return_counts=True)
        return item[met >= self.need[item]]


def align(pairs: list[tuple[np.ndarray, np.ndarray]], together: int = 128) -> np.ndarray:
    """Smith-Waterman score of each pair of word sequences.

    Pairs of about the same size are scored together: each row of their tables is one vector
    operation over all of them (a gap run in the row is a running maximum).
    """
    best = np.zeros(len(pairs), dtype=np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][1].size, pairs[k][0].size))
    for at in range(0, len(order), together):
        part = order[at : at + together]
        rows, width = max(pairs[k][0].size for k in part), max(pairs[k][1].size for k in part)
        a = np.full((len(part), rows), -1, dtype=np.int32)
        b = np.full((len(part), width), -2, dtype=np.int32)  # padding matches nothing, so it adds no score
        for i, k in enumerate(part):
            a[i, : pairs[k][0].size], b[i, : pairs[k][1].size] = pairs[k]
        shift = np.arange(width + 1, dtype=np.int32) * np.int32(-GAP)
        row = np.zeros((len(part), width + 1), dtype=np.int32)
        top = np.zeros(len(part), dtype=np.int32)
        for x in range(rows):
            up = np.maximum(row + np.int32(GAP), 0)
            np.maximum(up[:, 1:], row[:, :-1] + np.where(b == a[:, x : x + 1], np.int32(MATCH), np.int32(MISMATCH)), out=up[:, 1:])
            up += shift
            row = np.maximum.accumulate(up, axis=1) - shift
            np.maximum(top, row.max(axis=1), out=top)
        best[part] = top
    return best


def exact(item: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the item's words stand in the document in word-for-word stretches of N words or more."""
    own, codes = gram_codes(item, N), gram_codes(ids, N)
    if not own.size or not codes.size:
        return np.zeros(item.size, dtype=bool)
    order = np.argsort(codes, kind="stable")
    place = order[np.minimum(np.searchsorted(codes[order], own), codes.size - 1)]
    same = np.flatnonzero(codes[place] == own)
    span = np.arange(N)
    same = same[(item[same[:, None] + span] == ids[place[same][:, None] + span]).all(axis=1)]
    return covered(same, item.size, N)


def pair_row(ix: ItemIndex, i: int, ids: np.ndarray, codes: np.ndarray, seeds: np.ndarray) -> tuple[tuple, list[np.ndarray], np.ndarray] | None:
    """Coverage of item number ``i`` in a document, the windows in which to align it, and its seeds there."""
    item = ix.item(i)
    own = ix.seeds_of(i)
    met = seeds[np.minimum(np.searchsorted(seeds, own), seeds.size - 1)] == own
    seeded = int(covered(np.flatnonzero(met), item.size, SEED).sum())
    if seeded < SEEDED_SHARE * item.size:
        return None
    mask = exact(item, ids)
    stretches = int((mask & ~np.r_[False, mask[:-1]]).sum())
    # Where any of the item's seeds stand, with room for the item's other words on both sides.
    windows, end = [], -1
    held = np.unique(own[met])
    for s in np.flatnonzero(np.isin(codes, ix.seed_codes[held])):
        if s >= end:
            lo, hi = max(0, s - item.size), min(ids.size, s + 2 * item.size)
            windows.append(ids[lo:hi])
            end = hi - SEED
    n = int(mask.sum())
    return (int(ix.item_ids[i]), int(item.size), n, n / item.size, stretches, seeded), windows, held


def score(ix: ItemIndex, found: list[tuple[int, int, tuple, list[np.ndarray], np.ndarray]]) -> list[tuple]:
    """Rows with the best alignment score of their windows, and its share of a full copy's."""
    owner = [k for k, f in enumerate(found) for _ in f[3]]
    best = np.zeros(len(found), dtype=np.int64)
    np.maximum.at(best, owner, align([(ix.item(i), w) for _, i, _, windows, _ in found for w in windows]))
    return [(doc, *row, int(x), float(x / (MATCH * row[1])), i, held.tolist(), None, None) for (doc, i, row, _, held), x in zip(found, best, strict=True)]


def _search(shared):
    """Pass over documents: scored pairs, and at its end how many documents hold each seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: ItemIndex = shared.value
        count = np.zeros(ix.seed_codes.size, dtype=np.int64)
        for pdf in batches:
            found = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not isinstance(text, str):
                    continue
                ids, codes = ix.read(text)
                seeds = ix.hits(codes)
                count[seeds] += 1
                for i in ix.candidates(seeds).tolist():
                    pair = pair_row(ix, i, ids, codes, seeds)
                    if pair:
                        found.append((int(doc_id), i, *pair))
            if found:
                yield _frame(score(ix, found))
        held = np.flatnonzero(count)
        for at in range(0, held.size, 100_000):
            part = held[at : at + 100_000]
            yield _frame([(*[None] * 11, int(s), int(n)) for s, n in zip(part, count[part], strict=True)])

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=PAIR_COLUMNS)
    whole = [c for c in PAIR_COLUMNS if c not in ("coverage", "alignment_share", "seeds")]
    return out.astype({c: "Int64" for c in whole})


def _keep(common: np.ndarray, whole: np.ndarray):
    """Pairs that hold a rare seed, or whose item common seeds alone could give away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rare = np.array([not np.isin(s, common).all() for s in pdf["seeds"]], dtype=bool)
            yield pdf[rare | whole[pdf["item_no"].to_numpy(dtype=np.int64)]]

    return run


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 1 / 3) -> DataFrame:
    """Pairs of a document and an item it gives away, with coverage and alignment.

    ``documents``: doc_id (unique whole number), text; ``items``: item_id, text. A row has
    ``coverage`` (share of the item's words in word-for-word stretches of eight words or more) above
    ``share`` or ``alignment_share`` (Smith-Waterman score by that of the whole item) above
    ``ALIGNED_SHARE``; ``kind`` is ``verbatim`` or ``edited`` accordingly. Every pair of the first kind
    is among the rows; of the second, those in which stretches of five unchanged words make up a
    sixth of the item.

    NULL and empty texts match nothing; an item of fewer than five words can't leak; repeated items
    or documents give a row each under their own ids; texts are read whole, however long.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    its = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).distinct()
    size = its.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    result: DataFrame | None = None
    for b in range(blocks):
        block = its if blocks == 1 else its.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        ix = ItemIndex.of(((r.item_id, r.item_text) for r in block.orderBy("item_id", "item_text").toLocalIterator()), share)  # about BLOCK_CHARS characters
        searched = cut(docs.mapInPandas(_search(spark.sparkContext.broadcast(ix)), PAIR_SCHEMA))
        often = searched.where("seed IS NOT NULL").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > RARE_DOCUMENTS).select("seed").toPandas()  # at most one number per seed
        common = often["seed"].to_numpy(dtype=np.int64)
        marked = np.zeros(ix.seed_codes.size, dtype=bool)
        marked[common] = True
        whole = ix.words_in(marked) > share * np.diff(ix.at) if common.size else np.zeros(ix.item_ids.size, dtype=bool)
        found = searched.where("doc_id IS NOT NULL").mapInPandas(_keep(common, whole), PAIR_SCHEMA)
        result = found if result is None else result.unionByName(found)
    verbatim = F.col("coverage") > share
    return result.where(verbatim | (F.col("alignment_share") > ALIGNED_SHARE)).withColumn("kind", F.when(verbatim, "verbatim").otherwise("edited")).drop("item_no", "seeds", "seed", "n")
