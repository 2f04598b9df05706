"""Benchmark decontamination with a generalised suffix automaton of the test items (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import binary, keep, numbered, pieces

#: Every ASCII byte but digits and letters ends a word; A-Z become a-z; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
#: Words of items in one automaton.  More items are scanned in blocks, one automaton after the other.
BLOCK_WORDS = 100_000
#: A longer item is cut into pieces that overlap by a window less one word, so no window is lost.
PIECE_WORDS = 10_000


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with what is asked of a match: items, short items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids = [i for i, _ in items]
        self.code: dict[bytes, int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.link, self.length = [-1], [0]
        self.edges: list[list[int]] = [[]]
        coded = [[self.code.setdefault(w, len(self.code)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for c in words:
                last = self._extend(last, c)
        del self.edges
        self.holders: dict[int, set[int]] = {}
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(coded):
            state = matched = 0
            for c in words:
                state, matched = self.step(state, matched, c)
                if matched >= window:
                    self.holders.setdefault(self.at(state, window), set()).add(k)
            if 0 < len(words) < window:
                self.ends.setdefault(state, []).append((len(words), k))
        #: Nearest state on the way to the root, itself included, in which a short item ends.
        self.short = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[v] = v if v in self.ends else self.short[self.link[v]]
        shortest = min((len(w) for w in coded if w), default=0)
        #: No match shorter than this counts.
        self.least = min(window, shortest)
        pairs = np.array(sorted({(a, b) for w in coded for a, b in zip(w, w[1:])}), np.int64).reshape(-1, 2)
        self.pairs = pairs[:, 0] * max(1, len(self.code)) + pairs[:, 1]

    def _extend(self, last: int, c: int) -> int:
        """Append word c after state `last`; the generalised form, which reuses states of earlier items."""
        nxt, link, length, edges = self.next, self.link, self.length, self.edges
        known = nxt.get((last, c))
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            state = len(link)
            link.append(0)
            length.append(length[last] + 1)
            edges.append([])
        p = last
        if known is None:
            while p != -1 and (p, c) not in nxt:
                nxt[p, c] = state
                edges[p].append(c)
                p = link[p]
            if p == -1:
                return state
        q = nxt[p, c]
        if length[q] == length[p] + 1:
            target = q
        else:
            target = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            edges.append(list(edges[q]))
            for e in edges[q]:
                nxt[target, e] = nxt[q, e]
            link[q] = target
            while p != -1 and nxt.get((p, c)) == q:
                nxt[p, c] = target
                p = link[p]
        if known is not None:
            return target
        link[state] = target
        return state

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The longest suffix of the stream, now with word c, that occurs in an item."""
        while True:
            to = self.next.get((state, c))
            if to is not None:
                return to, matched + 1
            state = self.link[state]
            if state == -1:
                return 0, 0
            matched = self.length[state]

    def at(self, state: int, size: int) -> int:
        """The state of the suffix of that size."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are hit (None: none), and the numbers of the items that hit them.

        A match of several words is a chain of word pairs that occur in items, so only such chains
        are streamed through the automaton; all else would leave it at a shorter match.
        """
        if not self.least or len(words) < self.least:
            return None, set()
        get = self.code.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = codes >= 0
        chain = known[:-1] & known[1:]
        where = np.flatnonzero(chain)
        if len(where) and len(self.pairs):
            pair = codes[where] * len(self.code) + codes[where + 1]
            found = np.searchsorted(self.pairs, pair)
            found[found == len(self.pairs)] = 0
            chain[where] = self.pairs[found] == pair
        elif len(where):
            chain[where] = False
        # Runs of chained words: a run starts where the pair before it is broken.
        starts = np.flatnonzero(known & np.append(True, ~chain))
        ends = np.flatnonzero(known & np.append(~chain, True)) + 1
        long = ends - starts >= self.least
        if not long.any():
            return None, set()
        hit = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        window = self.window
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i in range(a, b):
                state, matched = self.step(state, matched, int(codes[i]))
                if matched >= window:
                    hit[i + 1 - matched] += 1
                    hit[i + 1] -= 1
                    items |= self.holders[self.at(state, window)]
                v = self.short[state]
                while v > 0:
                    for size, k in self.ends[v]:
                        if size <= matched:
                            hit[i + 1 - size] += 1
                            hit[i + 1] -= 1
                            items.add(k)
                    v = self.short[self.link[v]]
        hit = np.cumsum(hit[:-1]) > 0
        return (hit, items) if items else (None, set())


def automata(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text",
             block_words: int = BLOCK_WORDS) -> list:
    """One broadcast automaton for each block of items of about block_words words.

    Words are counted first; blocks are drawn by hash and reach the driver one at a time.
    """
    spark = items.sparkSession
    step = PIECE_WORDS - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, starts, runs = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                words = split_words(text)
                for start in range(0, max(1, len(words) - window + 1), step) if words else ():
                    ids.append(i)
                    starts.append(start)
                    runs.append(words[start:start + PIECE_WORDS])
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(starts, pa.int64()),
                                   pa.array(runs, pa.list_(pa.binary()))], names=["id", "start", "words"])

    parts = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "id string, start long, words array<binary>").distinct()
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words)
    out = []
    for k in range(n):
        block = parts.where(F.pmod(F.xxhash64("id", "start"), F.lit(n)) == k).orderBy("id", "start").collect()
        if block:
            built = Automaton([(r.id, [bytes(w) for w in r.words]) for r in block], window)
            out.append(spark.sparkContext.broadcast(built))
    return out


_found = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def spans_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def match(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, spans (runs of hit words) and items (ids, as strings, of the items that hit).

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window.  A word
    inside any occurrence of a window is hit.  Null and empty texts have no words; an item of a null id hits words, but
    is not listed; repeated items count once; rows pass one by one, whatever repeats.  Columns of docs named like
    the three are replaced.

    Nothing is shuffled: each row meets the automata, which are broadcast, in blocks of bounded size.  Between
    blocks the rows are written down, so that a task holds one automaton at a time.
    """
    blocks = automata(items, window, block_words=block_words)
    out = docs.drop("n_words", "spans", "items")
    names = out.columns
    if not blocks:
        blocks = [docs.sparkSession.sparkContext.broadcast(Automaton([], window))]
    return _matched(numbered(out), blocks, names.index(text_col)).toDF(*names, "n_words", "spans", "items")


def _matched(rows: DataFrame, blocks: list, at: int) -> DataFrame:
    """Rows with what all blocks find in column `at`, each of them on the same text."""
    out = rows.withColumns({"n_words": F.lit(0).cast("long"),
                            "spans": F.lit(None).cast("array<struct<start: long, end: long>>"),
                            "items": F.lit(None).cast("array<string>")})
    for k, block in enumerate(blocks):
        out = (keep(out, "match") if k else out).mapInArrow(_matcher(block, at), out.schema)
    return out


def _matcher(block, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.value
        for batch in pieces(batches):
            counts, spans, items = [], [], []
            n = batch.num_columns
            earlier = zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())
            for text, (old_spans, old_items) in zip(binary(batch.column(at)), earlier):
                words = split_words(text)
                hit, found = automaton.scan(words)
                counts.append(len(words))
                if hit is not None and old_spans:
                    for s in old_spans:
                        hit[s["start"]:s["end"]] = True
                spans.append(spans_of(hit) if hit is not None else old_spans or [])
                ids = {automaton.ids[k] for k in found} - {None}
                items.append(sorted(ids | set(old_items or ())))
            columns = [*batch.columns[:n - 3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_found)),
                       pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def report(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of match(): counts, the digest of the item ids and whether any word is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return matched.select(
        F.col(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5,
                 text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what matches items: spans of `window` words or more (or whole shorter items) go, and a
    document goes as a whole if they cover more than most_coverage of its words.

    A cut span leaves one line break.  If the words around a cut form a new match, that goes too, until there is
    none.  Texts without a match stay as they are, null and empty ones included; columns stay as they are.

    block_words has no influence on the rows: with several blocks, spans are collected over all of them before coverage
    is judged and texts are cut, and texts that were cut meet all blocks again.
    """
    blocks = automata(items, window, block_words=block_words)
    names, rows = docs.columns, numbered(docs)
    at = names.index(text_col)
    if len(blocks) < 2:
        for block in blocks:
            rows = rows.mapInArrow(_remover(block, at, most_coverage), rows.schema)
        return rows.toDF(*names)
    schema = rows.withColumn("again", F.lit(True)).schema
    settled, most = None, most_coverage
    while True:
        cut = keep(_matched(rows, blocks, at).mapInArrow(_cutter(at, most), schema), "decontaminate")
        rest = cut.where("not again").drop("again")
        settled = rest if settled is None else settled.union(rest)
        rows = cut.where("again").drop("again")
        if rows.isEmpty():
            return settled.toDF(*names)
        most = 1.0  # coverage is that of the unchanged text


def _word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    start, end = _word_places(text)
    parts, at = [], 0
    for s in spans:
        parts.append(text[at:start[s["start"]]].rstrip(b" "))
        at = end[s["end"] - 1]
    parts.append(text[at:].lstrip(b" "))
    return b"\n".join(parts)


def clean_text(automaton: Automaton, text: bytes, most_coverage: float) -> bytes | None:
    """The text without its matches, None if they cover too much of it."""
    first = True
    while True:
        hit, _ = automaton.scan(split_words(text))
        if hit is None:
            return text
        if first and hit.mean() > most_coverage or hit.all():
            return None
        first = False
        text = cut_spans(text, spans_of(hit))


def _cutter(at: int, most_coverage: float):
    """Of rows of _matched(): the columns before its own, with the spans cut out, and whether there were any.

    Rows go whose spans cover more than most_coverage of the words, or all of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_columns - 3
            texts, again, stay = [], [], []
            for text, words, spans in zip(binary(batch.column(at)), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                hit = sum(s["end"] - s["start"] for s in spans)
                again.append(hit > 0)
                stay.append(not hit or hit < words and hit / words <= most_coverage)
                texts.append(cut_spans(text, spans) if hit else text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns[:n])]
            fields = [pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.bool_())], schema=pa.schema(
                [*fields, pa.field("again", pa.bool_())])).filter(pa.array(stay, pa.bool_()))

    return run


def _remover(block, at: int, most_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.value
        for batch in pieces(batches):
            old = binary(batch.column(at))
            texts = [t if t is None else clean_text(automaton, t, most_coverage) for t in old]
            stay = pa.array([t is None or x is not None for t, x in zip(old, texts)], pa.bool_())
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                [pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)])).filter(stay)

    return run
