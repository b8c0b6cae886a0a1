"""Evaluation texts leaking into training text.

1. Both texts are normalised alike and read as a sequence of units: words, or for items in zh and ja
   letters and digits. Test items are taken in blocks of a bounded number of characters, one block of either
   kind at a time: it is broadcast, used in a round over the documents whose result is written, and released.
   So neither the driver nor an executor nor a task's closure holds more than a block of them.
2. Every document is scanned once a round for n-grams of the items (a rolling hash over the whole batch, looked
   up in the items' sorted table). Hits, their document frequencies and the seeds are tables.
3. For whole passages, seeds are rare n-grams: of each window of the required length in an item, the one that
   the fewest documents hold, at least one. A document that contains the window contains its seed, so seeds
   lose nothing. For edited copies every n-gram of an item is a seed: the rare ones are just those that an
   edited copy beside an exact one does not hold; pairs of units are seeds too, where enough of them are close
   together. With x edits (each a changed, missing or added unit) a copy with m matches shares m - x - 1 pairs at
   least. Similarity 0.5 means 2 m - x >= length, so that without added units m - x is a third of the item at
   least. Asked for are a quarter of the item's words, a third less one of its letters. Documents are then aligned
   where they are scanned.
4. Documents that share a seed with an item are aligned with it by Smith-Waterman over units, which scores
   edited and paraphrased copies; the longest common run is measured exactly alongside. Where seeds are n-grams,
   only what is within twice the item's length of a common n-gram is aligned: no copy of similarity 0.5 or
   more, nor a common run of the required length, reaches further.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.llm.tokens import slices
from veldt.operators.sizing import broadcast_if_small
from veldt.plans.materialize import Scratch

_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_PRIME = np.uint64(0x100000001B3)
#: languages whose items are compared by letters and digits
BY_CHARACTER = frozenset(("zh", "ja"))


@cache
def _invisible() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf")


#: A hyphen directly before a line break, between the halves of a word.
_BROKEN = re.compile(r"[-‐‑\u00ad](?<=[^\W_].)(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r]*(?=[^\W_])", re.DOTALL)


def normalise(text: str) -> str:
    """Without case, compatibility forms and invisible characters, broken words joined."""
    text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower()
    if hidden := _invisible().intersection(text):
        text = _BROKEN.sub("", text.translate(dict.fromkeys(map(ord, hidden))))
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
        if hidden := _invisible().intersection(text):
            text = text.translate(dict.fromkeys(map(ord, hidden)))
        text = _BROKEN.sub("", text)
    text = text.casefold()
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def words(text: str) -> list[str]:
    return _WORD.findall(text)


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def points(text: str) -> np.ndarray:
    """Code points of the letters and digits of a normalised text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return x[_alnum()[x]].astype(np.int64)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place; 0 where it holds a unit of code 0 or runs out."""
    out = np.zeros(len(codes), dtype=np.uint64)
    if len(codes) < n:
        return out
    m = len(codes) - n + 1
    h, known = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
    for k in range(n):
        part = codes[k : k + m]
        h = (h ^ part.astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
        known &= part > 0
    out[:m] = np.where(known, h | np.uint64(1), 0)
    return out


class Items:
    """A block of test items as unit codes, with their n-grams and windows."""

    def __init__(self, rows: list[tuple[int, str]], by_character: bool, n: int, window: int):
        self.by_character, self.n, self.window = by_character, n, window
        self.vocabulary: dict = {}
        self.codes: dict[int, np.ndarray] = {}
        for item, text in rows:
            units = points(normalise(text)).tolist() if by_character else words(normalise(text))
            self.codes[item] = np.array([self.vocabulary.setdefault(u, len(self.vocabulary) + 1) for u in units], dtype=np.int64)
        grams = {i: _grams(c, n) for i, c in self.codes.items()}
        self.table = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams.values()]))
        self.table = self.table[self.table > 0]
        self.grams = {i: np.searchsorted(self.table, g[: max(0, len(g) - n + 1)]) for i, g in grams.items()}
        self.ids, self.lengths = list(self.codes), np.array([len(c) for c in self.codes.values()], dtype=np.int64)
        #: n-grams that a copy must share
        self.least = np.ones(len(self.ids), dtype=np.int64)
        held = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(g) * len(self.ids) + k for k, g in enumerate(self.grams.values()))]))
        #: where the items of each n-gram begin, and their places
        self.owners = np.searchsorted(held, np.arange(len(self.table) + 1) * len(self.ids)), held % max(1, len(self.ids))
        self.any_latin = by_character and any(not _CJK.search("".join(map(chr, x))) for c in self.codes.values() for x in self._windows(c))
        if by_character and not self.any_latin:  # half of an item may be a copy too
            cjk = np.array([0, *(bool(_CJK.match(chr(u))) for u in self.vocabulary)])
            self.any_latin = any(2 * cjk[c].sum() <= len(c) for c in self.codes.values())
        self._lookup: np.ndarray | None = None  # made where it is used, so that tasks stay small

    def _windows(self, codes: np.ndarray) -> Iterator[list[int]]:
        units = {c: u for u, c in self.vocabulary.items()}
        for i in range(max(0, len(codes) - self.window + 1)):
            yield [units[c] for c in codes[i : i + self.window].tolist()]

    def read(self, text: str) -> np.ndarray:
        """Codes of a normalised text's units; 0 for units that no item holds."""
        if self.by_character:
            if not self.any_latin and not _CJK.search(text):
                return np.zeros(0, np.int64)
            if self._lookup is None:
                self._lookup = np.zeros(0x110000, dtype=np.int64)
                for u, c in self.vocabulary.items():
                    self._lookup[u] = c
            return self._lookup[points(text)]
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def near(self, codes: np.ndarray, items: list[int]) -> list[np.ndarray]:
        """Of a document's codes, for each item those within twice its length of a common n-gram; 0 between the parts."""
        grams = _grams(codes, self.n)
        at = np.flatnonzero(grams)
        place = np.minimum(np.searchsorted(self.table, grams[at]), max(0, len(self.table) - 1))
        hit = self.table[place] == grams[at] if len(self.table) else np.zeros(len(at), bool)
        at, place, out = at[hit], place[hit], []
        for item in items:
            mine, reach = at[np.isin(place, self.grams[item])], 2 * len(self.codes[item])
            steps = np.zeros(len(codes) + 2, dtype=np.int64)
            np.add.at(steps, np.maximum(0, mine - reach), 1)
            np.add.at(steps, np.minimum(len(codes), mine + self.n + reach), -1)
            inside = np.cumsum(steps)[: len(codes) + 1] > 0
            taken = inside.copy()
            taken[1:] |= inside[:-1]  # one more place after each part
            out.append(np.where(inside, np.append(codes, 0), 0)[taken])
        return out


def _padded(rows: list[np.ndarray], filler: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), filler, dtype=np.int32)
    for row, codes in zip(out, rows, strict=True):
        row[: len(codes)] = codes
    return out


def _chunks(docs: list[np.ndarray], items: list[np.ndarray], cells: int = 32_768) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places, documents and items of pairs of like lengths, so that a chunk's padded rows stay within the cache; pairs with an empty side are left out."""

    def made(chunk: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        return chunk, _padded([np.where(docs[i] > 0, docs[i], -2) for i in chunk], -2), _padded([items[i] for i in chunk], -1)

    chunk: list[int] = []
    kind = lambda i: (len(items[i]) // 32, len(docs[i]))
    for i in sorted((i for i in range(len(docs)) if len(docs[i]) and len(items[i])), key=kind):
        if chunk and ((len(chunk) + 1) * len(docs[i]) > cells or kind(chunk[0])[0] != kind(i)[0]):
            yield made(chunk)
            chunk = []
        chunk.append(i)
    if chunk:
        yield made(chunk)


def scores(docs: list[np.ndarray], items: list[np.ndarray], match: int = 2, mismatch: int = 1, gap: int = 1, least: np.ndarray | None = None) -> np.ndarray:
    """Smith-Waterman score of every document's codes with those of its item; code 0 matches nothing.

    A row of the matrix of many pairs at a time: gaps along the row are a running maximum, by doubling.
    A pair that cannot reach its score of ``least`` any more is left; what it has then is below it too.
    """
    out = np.zeros(len(docs), dtype=np.int64)
    for chunk, doc, item in _chunks(docs, items):
        rows, n = doc.shape
        places, lengths = np.array(chunk), (item > -1).sum(axis=1).astype(np.int64)
        wanted = lengths if least is None else least[places]
        kind = np.int16 if gap * n + match * item.shape[1] < 30_000 else np.int32
        slope = (gap * np.arange(n)).astype(kind)
        above = np.zeros((rows, n + 1), dtype=kind)
        step, here, best = (np.zeros((rows, n), dtype=kind) for _ in range(3))
        for k in range(item.shape[1]):
            np.multiply(doc == item[:, k : k + 1], kind(match + mismatch), out=step)
            step += above[:, :-1]
            step -= kind(mismatch)
            np.subtract(above[:, 1:], kind(gap), out=here)
            np.maximum(step, here, out=here)
            np.maximum(here, kind(0), out=here)
            top, reach = int(here.max()), 1
            here += slope
            while reach * gap <= top and reach < n:  # a gap that costs more than the best score leaves nothing
                step[:, :reach] = here[:, :reach]
                np.maximum(here[:, reach:], here[:, :-reach], out=step[:, reach:])
                here, step, reach = step, here, 2 * reach
            np.subtract(here, slope, out=above[:, 1:])
            np.maximum(best, above[:, 1:], out=best)
            if least is not None and k % 8 == 7:
                reached = best.max(axis=1)
                alive = np.maximum(above.max(axis=1) + match * (lengths - k - 1), reached) >= wanted
                if 4 * alive.sum() < 3 * len(alive):
                    out[places[~alive]] = reached[~alive]
                    if not alive.any():
                        break
                    doc, item, above, best, places, lengths, wanted = (x[alive] for x in (doc, item, above, best, places, lengths, wanted))
                    step, here = np.empty_like(best), np.empty_like(best)
        else:
            out[places] = best.max(axis=1)
    return out


def longest_runs(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Longest common run of every document's codes with those of its item; code 0 matches nothing."""
    out = np.zeros(len(docs), dtype=np.int64)
    for chunk, doc, item in _chunks(docs, items):
        run, longest = np.zeros((len(doc), doc.shape[1] + 1), dtype=np.int32), np.zeros(len(doc), dtype=np.int32)
        for k in range(item.shape[1]):
            run[:, 1:] = (run[:, :-1] + 1) * (doc == item[:, k : k + 1])
            np.maximum(longest, run.max(axis=1), out=longest)
        out[chunk] = longest
    return out


def align(doc: np.ndarray, item: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> tuple[int, int]:
    """(Smith-Waterman score, longest common run) of two code sequences; code 0 matches nothing."""
    return int(scores([doc], [item], match, mismatch, gap)[0]), int(longest_runs([doc], [item])[0])


def _scan(docs: DataFrame, key: str, text: str, shared: Broadcast) -> DataFrame:
    """(key, block, gram): the item n-grams of every document, each once."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [normalise(t) if t else "" for t in batch.column(1).to_pylist()]
            for b, items in enumerate(shared.value):
                if not len(items.table):
                    continue
                codes = [items.read(t) for t in texts]
                # one sequence for the batch; a zero keeps documents apart
                flat = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.int64))])
                grams = _grams(flat, items.n)
                at = np.flatnonzero(grams)
                place = np.searchsorted(items.table, grams[at])
                hit = items.table[np.minimum(place, len(items.table) - 1)] == grams[at]
                of = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])[at[hit]]
                pairs = np.unique(of * len(items.table) + place[hit])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(pairs // len(items.table))), pa.array(np.full(len(pairs), b, np.int32)), pa.array((pairs % len(items.table)).astype(np.int64))],
                    names=[key, "block", "gram"],
                )

    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, block int, gram long")


def _item_grams(listed: DataFrame, shared: Broadcast) -> DataFrame:
    """(block, item, at, gram) of every place of an n-gram in the items of the round."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0).to_pylist():
                b, items = next((b, x) for b, x in enumerate(shared.value) if item in x.grams)
                grams = items.grams[item].astype(np.int64)
                n = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, item, np.int64)), pa.array(np.arange(n)), pa.array(grams)], names=["block", "item", "at", "gram"])

    return listed.select("item").mapInArrow(rows, "block int, item long, at long, gram long")


def _rare_seeds(grams: DataFrame, hits: DataFrame, spans: list[int]) -> DataFrame:
    """(block, gram, item): of every window of ``spans[block]`` n-grams the one that the fewest documents hold, but at least one does.

    Grams that no document holds find nothing; a window with one of them occurs nowhere whole.
    """
    held = hits.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("documents"))
    known = grams.join(held, ["block", "gram"], "left")
    best = F.min(F.when(F.col("documents") > 0, F.struct("documents", "gram")))
    parts = []
    for b, span in enumerate(spans):
        window = W.partitionBy("item").orderBy("at").rowsBetween(0, span - 1)
        whole = F.count(F.lit(1)).over(window) == span
        parts.append(known.filter(F.col("block") == b).select("block", "item", best.over(window).alias("best"), whole.alias("whole")).filter("whole AND best IS NOT NULL"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.select("block", F.col("best.gram").alias("gram"), "item").distinct()


def _aligned(found: DataFrame, key: str, text: str, shared: Broadcast) -> DataFrame:
    kind = found.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in slices(batches):
            index, which, texts = [], [], []
            for r, (value, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                clean = normalise(value or "")
                by_block: dict[int, list[int]] = {}
                for x in wanted:
                    by_block.setdefault(x["block"], []).append(x["item"])
                for b, mine in by_block.items():
                    index += [r] * len(mine)
                    which += [(blocks[b], i) for i in mine]
                    texts += blocks[b].near(blocks[b].read(clean), mine)
            wanted = [items.codes[i] for items, i in which]
            out = []
            for (items, i), score, longest in zip(which, scores(texts, wanted).tolist(), longest_runs(texts, wanted).tolist(), strict=True):
                out.append((i, "characters" if items.by_character else "words", score / (2 * len(items.codes[i])), longest, longest >= items.window))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "item_id", "unit", "similarity", "longest_run", "contains"])

    return found.mapInArrow(rows, f"`{key}` {kind}, item_id long, unit string, similarity double, longest_run int, contains boolean")


def _likely(items: Items, codes: list[np.ndarray], least: int | None = None, within: int | None = None) -> np.ndarray:
    """Pairs that share enough n-grams close together, as document place times number of items plus item place.

    Enough is ``items.least`` of the item, close is within twice its length: a copy of similarity 0.5 or more spans no more.
    """
    if not len(items.table):
        return np.zeros(0, np.int64)
    flat = np.concatenate([x for c in codes for x in (c, np.zeros(1, np.int64))])
    grams = _grams(flat, items.n)
    at = np.flatnonzero(grams)
    place = np.minimum(np.searchsorted(items.table, grams[at]), len(items.table) - 1)
    hit = items.table[place] == grams[at]
    at, place = at[hit], place[hit]
    first, owners = items.owners
    count = first[place + 1] - first[place]
    # every hit once per item that holds the n-gram
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, at = owners[np.repeat(first[place], count) + nth], np.repeat(at, count)
    of = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])[at]
    order = np.lexsort((at, item, of))
    item, at, of = item[order], at[order], of[order]
    # the hit with which there would be enough, counted from each
    last = np.arange(len(at)) + (items.least[item] if least is None else least) - 1
    able = np.flatnonzero(last < len(at))
    last = last[able]
    near = (of[last] == of[able]) & (item[last] == item[able]) & (at[last] - at[able] <= (2 * items.lengths[item[able]] if within is None else within))
    return np.unique(of[able[near]] * len(items.lengths) + item[able[near]])


def _resembling(docs: DataFrame, key: str, text: str, shared: Broadcast, similarity: float) -> DataFrame:
    """The rows of :func:`leaked_passages` with edited copies: documents are scanned and aligned in one pass."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [normalise(t) if t else "" for t in batch.column(1).to_pylist()]
            for items, short in shared.value:
                codes = [items.read(t) for t in texts]
                pairs = np.union1d(_likely(items, codes), _likely(short, codes))
                seeded = _likely(items, codes, items.window - items.n + 1, items.window - items.n)
                of, which = pairs // max(1, len(items.ids)), pairs % max(1, len(items.ids))
                unit, length = "characters" if items.by_character else "words", items.lengths
                sequences = list(items.codes.values())
                # without as many n-grams on end no passage is contained
                least = np.where(np.isin(pairs, seeded), np.minimum(similarity * 2 * length[which], 2 * items.window), similarity * 2 * length[which])
                score = scores([codes[i] for i in of.tolist()], [sequences[w] for w in which.tolist()], least=least)
                good = score >= np.minimum(similarity * 2 * length[which], 2 * items.window)  # a run scores twice its length at least
                of, which, score = of[good], which[good], score[good]
                runs = longest_runs([codes[i] for i in of.tolist()], [sequences[w] for w in which.tolist()])
                good = (runs >= items.window) | (score >= similarity * 2 * length[which])
                index = of[good]
                out = [(items.ids[w], unit, s / (2 * int(length[w])), run, run >= items.window) for w, s, run in zip(which[good].tolist(), score[good].tolist(), runs[good].tolist(), strict=True)]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "item_id", "unit", "similarity", "longest_run", "contains"])

    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, item_id long, unit string, similarity double, longest_run int, contains boolean")


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    item_lang: str = "lang",
    window: int = 10,
    window_characters: int = 24,
    n: int = 5,
    n_characters: int = 12,
    block_characters: int = 10_000_000,
    edited: bool = True,
    similarity: float = 0.5,
) -> DataFrame:
    """(key, item_id, unit, similarity, longest_run, contains) of every document and item it holds a passage of.

    With ``edited``, every n-gram of an item is a seed and the rows are those that contain a passage or reach
    ``similarity``, in one narrow pass. Without, the rows are those with a common rare seed: all that
    contain a passage, and no promise for edited copies.

    ``contains``: the document holds at least ``window`` consecutive words of the item, for zh and ja
    items ``window_characters`` consecutive letters or digits; similarity is the alignment score
    as a share of a full copy's. Out of reach are edited copies with m matches and x edits where m - x - 1 is
    below a quarter of the item's words, a third less one of its letters, and that share no n-gram of ``n`` or
    ``n_characters`` either: those with units added at most places, items of under four units with a change,
    and items of one unit. Defined results: null and empty texts match nothing, items shorter than the window are
    not contained in any; repeated documents give repeated rows; other columns are not read; an empty table on
    either side gives an empty result; items need distinct ids. Items are taken in blocks of some
    ``block_characters``, so that what the driver and an executor hold does not grow with their number.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    listed, rounds = _rounds(items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"), F.col(item_lang).alias("lang")), block_characters, scratch)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = []
    for k in range(rounds):
        mine = listed.filter(F.col("round") == k)
        rows = mine.select("item", "text", "by_character").collect()  # a block of either kind at most
        blocks = []
        for by_character, size, gram in ((False, window, n), (True, window_characters, n_characters)):
            if some := [(r.item, r.text) for r in rows if r.by_character == by_character]:
                blocks.append((Items(some, by_character, gram, size), Items(some, by_character, 2, size) if edited else None))
        if edited:
            for _, short in blocks:
                short.least = np.maximum(1, short.lengths // 4 if not short.by_character else -(-short.lengths // 3) - 1)
            shared = spark.sparkContext.broadcast(blocks)
            results.append(scratch.write(_resembling(docs, key, text, shared, similarity), f"result-{k}"))
        else:
            shared = spark.sparkContext.broadcast([b for b, _ in blocks])
            hits = scratch.write(_scan(docs, key, text, shared), f"hits-{k}")
            seeds = _rare_seeds(_item_grams(mine, shared), hits, [b.window - b.n + 1 for b, _ in blocks])
            seeds = scratch.write(seeds, f"seeds-{k}")
            wanted = F.collect_set(F.struct("block", "item")).alias("wanted")  # of the block's items
            pairs = scratch.write(hits.join(broadcast_if_small(seeds), ["block", "gram"]).groupBy(key).agg(wanted), f"pairs-{k}")
            found = docs.select(key, text).join(broadcast_if_small(pairs, 100_000), key)
            # few documents are left: spread them before the costly step
            aligned = _aligned(found.select(key, text, "wanted").repartition(parts), key, text, shared)
            results.append(scratch.write(aligned, f"result-{k}"))
            for name in ("hits", "seeds", "pairs"):
                scratch.drop(f"{name}-{k}")
        shared.destroy()
    scratch.drop("items")
    if not results:
        kind = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, item_id long, unit string, similarity double, longest_run int, contains boolean")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _rounds(items: DataFrame, block_characters: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(item, text, by_character, round) of the items with a text, and the number of rounds.

    Items are dealt to the rounds by a hash of their id, so that a round has some ``block_characters`` of
    either kind.
    """
    by_character = F.coalesce(F.substring(F.lower(F.trim("lang")), 1, 2), F.lit("")).isin(*sorted(BY_CHARACTER))
    known = items.filter("text IS NOT NULL AND item IS NOT NULL").select("item", "text", by_character.alias("by_character"))
    totals = known.groupBy("by_character").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    rounds = max((-(-r.n // block_characters) for r in totals), default=0)
    number: Column = F.pmod(F.xxhash64("item"), F.lit(max(1, rounds))).cast("int")
    return scratch.write(known.withColumn("round", number), "items"), rounds


def windows_in(docs: DataFrame, items: list[tuple[int, str | None, str | None]], key: str = "doc_id", text: str = "text", window: int = 10, window_characters: int = 24) -> DataFrame:
    """(key, item_id) of every document that holds a whole window of one of the few ``items``, by brute force: the check of :func:`leaked_passages`."""
    kind = docs.schema[key].dataType.simpleString()

    def parts(value: str | None, by_character: bool) -> set[str]:
        clean = normalise(value or "")
        units = list(map(chr, points(clean))) if by_character else words(clean)
        n = window_characters if by_character else window
        return {" ".join(units[i : i + n]) for i in range(len(units) - n + 1)}

    owners: dict[bool, dict[str, set[int]]] = {False: {}, True: {}}
    for item, value, lang in items:
        by_character = (lang or "").strip().lower()[:2] in BY_CHARACTER
        for x in parts(value, by_character):
            owners[by_character].setdefault(x, set()).add(item)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            index, found = [], []
            for r, value in enumerate(batch.column(1).to_pylist()):
                mine = {i for by_character, known in owners.items() for x in parts(value, by_character) & known.keys() for i in known[x]}
                index += [r] * len(mine)
                found += sorted(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(found, pa.int64())], names=[key, "item_id"])

    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, item_id long")


def leak_report(leaks: DataFrame) -> DataFrame:
    """(item_id, documents, contained, best): per leaked item how many documents hold or resemble it."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("contains").cast("long")).alias("contained"), F.max("similarity").alias("best"))
