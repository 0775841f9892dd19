"""Dictionary scans: which words of a dictionary stand in a text, found in one pass over each text.

The dictionary is a table. Its distinct words are dealt into blocks of bounded size; a block is broadcast as an automaton
and the texts are read once for each block, where they lie: texts never shuffle. What a block finds is written and the block
given up before the next is broadcast, so a larger dictionary takes more passes, not more memory. Words and texts are
compared as they are; lower both sides for a comparison without case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path

#: Words in one broadcast block; cards in one, and words of them for each of ``BLOCK_WORDS`` (most of them are words of others too).
BLOCK_WORDS, BLOCK_CARDS, CARD_SIZE = 200_000, 1_000_000, 50
#: So many texts, and characters of them, are few: they are sent to the cards. Cards that such texts meet at once.
FEW_TEXTS, FEW_CHARACTERS, MET_CARDS = 1_000, 4_000_000, 100_000
#: Fixed value: the confidence that ranks first.
SURE = "high"
#: Words that an entry of a card knows besides its own.
AHEAD = 3
#: Rows in one batch of results.
BATCH_ROWS = 100_000


def automaton(words: list[str]):
    """An automaton over distinct words that yields their places in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    if words:
        found.make_automaton()
    return found


def standing(machine, text: str | None) -> np.ndarray:
    """Places of the distinct words that stand in the text, in order."""
    if not text or not len(machine):
        return np.zeros(0, np.int64)
    found = set(map(itemgetter(1), machine.iter(text)))
    return np.sort(np.fromiter(found, np.int64, len(found)))


def passes(words: DataFrame, key: str, one: Callable[[Broadcast], DataFrame], most: int | None = None) -> DataFrame:
    """The results of ``one`` for every block of a table, united. A block is a broadcast list of tuples, about ``most`` rows,
    dealt by a hash of ``key``; of several, each is given up when its results are written."""
    spark, most = words.sparkSession, most or BLOCK_WORDS
    n = max(1, -(-words.count() // most))
    return blocks(words, key, n, lambda rows: spark.sparkContext.broadcast([tuple(r) for r in rows.toLocalIterator()]), one)


def blocks(rows: DataFrame, key: str, n: int, block: Callable[[DataFrame], Broadcast], one: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The results of ``one`` for ``n`` blocks of a table, dealt by a hash of ``key``, each broadcast by ``block``."""
    spark = rows.sparkSession
    if n == 1:
        return one(block(rows))
    paths = []
    for i in range(n):
        shared = block(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i))
        found = one(shared)
        paths.append(shared_path(spark, "pass"))
        found.write.parquet(paths[-1])
        shared.destroy()
    return spark.read.schema(found.schema).parquet(*paths)


def hits(rows: DataFrame, key: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """``(key, word)``: the distinct non-blank words that stand in each text, once for each row that holds them."""
    known = words.select(word).where(F.trim(word) != "").distinct()
    schema = rows.select(key).schema.add(word, "string")

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [w for (w,) in shared.value]
            machine, column = automaton(names), pa.array(names, pa.string())
            for b in batches:
                at, found, n = [], [], 0
                for i, t in enumerate(b["__t"].to_pylist()):
                    f = standing(machine, t)
                    at.append(np.full(len(f), i))
                    found.append(f)
                    n += len(f)
                    if n >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([b[key].take(pa.array(np.concatenate(at))), column.take(pa.array(np.concatenate(found)))], [key, word])
                        at, found, n = [], [], 0
                if n:
                    yield pa.RecordBatch.from_arrays([b[key].take(pa.array(np.concatenate(at))), column.take(pa.array(np.concatenate(found)))], [key, word])

        return rows.select(key, F.col(text).alias("__t")).mapInArrow(run, schema)

    return passes(known, word, one)


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b)``: distinct names a of ``left`` and b of ``right`` of which one contains the other; blank names never do."""
    a, b = (df.select(c).where(F.trim(c) != "").distinct() for df, c in ((left, "a"), (right, "b")))
    down = hits(a, "a", "a", b, "b")
    up = hits(b, "b", "b", a, "a").select("a", "b")
    return down.unionByName(up).distinct()


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of several runs, ``many`` of each, one run after another."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


class Cards:
    """Cards of one block, as arrays: a card's words are numbers, rarest first, where 0 is the word of the fewest cards.

    A card of n words of which m stand in a text has one of them among its n - m + 1 rarest. So the word at place i of a card
    is entered under the level n - i, and who wants all cards with at least m words in a text reads the levels from the highest
    down to m, of the words that stand there. Lists of common words are met only at low levels. An entry knows the next
    ``AHEAD`` words of its card: those that do not stand in the text tell how many of its words can at most, and the card is
    counted at that level only, so most of what is entered is never counted.
    """

    def __init__(self, table: pa.Table) -> None:
        unsure = pc.not_equal(table["confidence"].fill_null(""), SURE)
        ranks = pa.table({"unsure": unsure.cast(pa.int8()), "id": table["card_id"], "confidence": table["confidence"].fill_null(""), "project": table["project"].fill_null("")})
        order = pc.sort_indices(ranks, [(c, "ascending") for c in ranks.column_names])
        table = table.take(order).combine_chunks()
        self.ids, self.sure, projects = (table[n].combine_chunks() for n in ("card_id", "confidence", "project"))
        sets: dict[tuple, int] = {}  # cards need few different sets of domains
        self.needs = np.array([sets.setdefault(tuple(n or ()), len(sets)) for n in table["needs"].to_pylist()], np.int32)
        self.sets = list(sets)
        words, strong = table["words"].combine_chunks(), table["strong"].combine_chunks()
        many = words.value_lengths().to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        held = np.bincount(codes, minlength=len(names))
        by = np.argsort(held, kind="stable")
        number = np.empty(len(names), np.int64)
        number[by] = np.arange(len(names))
        self.names = names.take(pa.array(by)).to_pylist()
        owner, flat = np.repeat(np.arange(len(many)), many), number[codes]
        at = np.argsort(owner * len(names) + flat)
        self.begin = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        self.flat, self.strong = flat[at].astype(np.int32), strong.flatten().to_numpy().astype(np.int8)[at]
        self.any_strong, self.top = bool(self.strong.any()), int(many.max(initial=0))
        place = np.arange(len(owner)) - self.begin[owner]
        level = many[owner] - place
        by = np.argsort((self.flat.astype(np.int64) + 1) * (self.top + 1) - level, kind="stable")
        self.entered, self.level = owner[by].astype(np.int32), np.append(level[by], 0).astype(np.int32)
        self.ahead = np.full((len(owner), AHEAD), len(names), np.int32)  # the last word stands nowhere
        for i in range(AHEAD):
            more = np.flatnonzero(level[by] > i + 1)
            self.ahead[more, i] = self.flat[by[more] + i + 1]
        self.first = np.searchsorted(self.flat[by], np.arange(len(names) + 1))
        heads = np.flatnonzero(np.concatenate([[True], (self.level[1:-1] != self.level[:-2]) | (np.diff(self.flat[by]) != 0)])) if len(owner) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(owner)))
        self.after = np.repeat(heads + sizes, sizes)
        coded = projects.fill_null("").dictionary_encode()
        self.projects, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.by_project = np.argsort(of, kind="stable")
        self.project_at = np.searchsorted(of[self.by_project], np.arange(len(self.projects) + 1))
        self.machines: dict[str, object] = {}

    def machine(self, of: str):
        """The automaton of the words or of the projects, made once."""
        if of not in self.machines:
            self.machines[of] = automaton(self.names if of == "names" else [p or "\0" for p in self.projects])
        return self.machines[of]

    def walk(self, words: np.ndarray, lowest: int) -> Iterator[tuple[int, np.ndarray]]:
        """The levels down to ``lowest``, each with the entries of the distinct ``words`` under it. A word's entries lie by level,
        and each knows where the next level begins, so words without cards at a level cost nothing."""
        at, end = self.first[words], self.first[words + 1]
        here = self.level[at]
        for level in range(self.top, lowest - 1, -1):
            on = np.flatnonzero(here == level)
            start = at[on]
            then = self.after[start]
            yield level, _ranges(start, then - start)
            at[on] = then
            here[on] = np.where(then < end[on], self.level[then], 0)

    def entries(self, level: int, words: np.ndarray) -> np.ndarray:
        """Cards with one of ``words`` entered under ``level``, each once."""
        return next(self.entered[entry] for at, entry in self.walk(words, level) if at == level)

    def levels(self, words: np.ndarray, mark: np.ndarray, lowest: int) -> Iterator[tuple[int, np.ndarray]]:
        """The levels down to ``lowest`` for the distinct ``words``, which are marked, each with the cards to be counted there:
        after a level, all cards with so many marked words have been told, some more than once."""
        later: list[list[np.ndarray]] = [[] for _ in range(self.top + 1)]
        for level, entry in self.walk(words, lowest):
            if len(entry):
                cards, lacking = self.entered[entry], min(AHEAD, level - 1) - mark[self.ahead[entry]].sum(axis=1)
                for i in range(min(AHEAD, level - lowest) + 1):
                    later[level - i].append(cards[lacking == i])
            yield level, np.concatenate(later[level]) if later[level] else self.entered[:0]
            later[level] = []

    def counts(self, cards: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words of each card are marked, and whether a strong one is; cards have words."""
        many = self.begin[cards + 1] - self.begin[cards]
        at = _ranges(self.begin[cards], many)
        here, cut = mark[self.flat[at]], np.cumsum(many) - many
        strong = np.maximum.reduceat(here * self.strong[at], cut) > 0 if self.any_strong else np.zeros(len(cards), bool)
        return np.add.reduceat(here, cut, dtype=np.int64), strong

    def of_projects(self, projects: Sequence[int]) -> np.ndarray:
        """Cards of the projects that have words, in order."""
        found = [self.by_project[self.project_at[p] : self.project_at[p + 1]] for p in projects]
        cards = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return cards[self.begin[cards + 1] > self.begin[cards]]


#: The last broadcast block that this worker has read, and its cards: tasks of a worker share them.
_last: list = []


def _cards(table: pa.Table) -> Cards:
    if not _last or _last[0] is not table:
        _last[:] = []
        _last[:] = [table, Cards(table)]
    return _last[1]


def _namesakes(names: list[str | None], projects: list[str], machine) -> list[list[int]]:
    """For each name the projects (their places) of which one contains the other; blank projects and empty names have none.
    ``machine``: the automaton of the projects."""
    known = sorted({n for n in names if n})
    found = {n: {i for i in standing(machine, n) if projects[i].strip()} for n in known}
    if known:
        inner = automaton(known)
        for i, p in enumerate(projects):
            for k in standing(inner, p) if p.strip() else ():
                found[known[k]].add(i)
    return [sorted(found[n]) if n else [] for n in names]


def card_hits(docs: DataFrame, words: DataFrame, doc: str, text: str, least: int = 1, limit: int | None = None, name: str | None = None, own_least: int = 1, own_limit: int | None = None, guard: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """``(doc, card_id, confidence, overlap, strong, own)``: how many words of each card stand in each text.

    ``words``: card_id, confidence, word, strong, project and needs, one row for each distinct word of a card. A row comes back
    where ``least`` words stand in the text, or, if ``least`` is at most two, one strong word. With ``name``, cards whose
    project contains the document's name, or is contained in it, are ``own`` and judged by ``own_least`` and
    ``own_limit`` instead. ``guard`` lists domains, each a term and its aliases: a card that ``needs`` a domain (its number
    in the list) is no match for a text without any of its aliases, unless the card is the document's own. Only the best
    ``limit`` cards of a document and block are returned: more overlap first, then high confidence, then the smaller id; so the
    best of all blocks are among them. With a limit, a text reads the levels of ``Cards`` from the highest down and stops at
    the one where it has enough, so cards with a few common words cost it nothing. Where the texts are few they are broadcast
    instead, and the cards stay where they are: ``MET_CARDS`` of them are a block then, so the driver holds no card.
    """
    schema = T.StructType([docs.schema[doc], *(T.StructField(n, t) for n, t in (("card_id", T.StringType()), ("confidence", T.StringType()), ("overlap", T.LongType()), ("strong", T.IntegerType()), ("own", T.BooleanType())))])
    columns = [doc, text] + ([name] if name else [])
    aliases = sorted({a for _, own in guard for a in own if a})
    spot_of = {a: i for i, a in enumerate(aliases)}
    domains = [np.array([spot_of[a] for a in own if a], np.int64) for _, own in guard]
    grouped = words.groupBy("card_id", "confidence", "project", "needs").agg(F.collect_list("word").alias("words"), F.collect_list("strong").alias("strong"))

    def scanned(cards: Cards, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, guarding, n = cards.machine("names"), automaton(aliases), len(cards.ids)
        sites = cards.machine("projects") if name else None
        mark, seen = np.zeros(len(cards.names) + 1, np.int8), np.zeros(n, bool)

        def best(at: np.ndarray, count: np.ndarray, most: int | None) -> np.ndarray:
            """Places within ``at``, cards in order, of the best ones."""
            if most is None or len(at) <= most:
                return np.arange(len(at))
            return np.argpartition(-count * n + at, most - 1)[:most]

        def found(here: np.ndarray, own: np.ndarray, shut: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Other cards that fit, with counts and strong marks: all of them, or enough for the limit, ties included."""
            parts, met = [], [own]
            seen[own] = True
            fits = np.array([shut.isdisjoint(s) for s in cards.sets]) if shut else None
            for level, new in cards.levels(here, mark, lowest):
                new = new[~seen[new]]
                if len(new):
                    new = np.unique(new)
                    seen[new] = True
                    met.append(new)
                    c, s = cards.counts(new, mark)
                    fit = (c >= least) | (s & (least <= 2))
                    if fits is not None:
                        fit &= fits[cards.needs[new]]
                    parts.append((new[fit], c[fit], s[fit]))
                if limit is not None and sum(np.count_nonzero(c >= level) for _, c, _ in parts) >= limit:
                    break
            for m in met:
                seen[m] = False
            if not parts:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            hit, count, strong = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hit)
            return hit[order], count[order], strong[order]

        out, size, lowest = [], 0, 1 if least <= 2 and cards.any_strong else max(1, least)
        for b in batches:
            texts = b[text].to_pylist()
            mine = _namesakes(b[name].to_pylist(), cards.projects, sites) if name else None
            for i, t in enumerate(texts):
                here = standing(machine, t)
                if not len(here):
                    continue
                mark[here] = 1
                own = cards.of_projects(mine[i]) if mine and mine[i] else np.zeros(0, np.int64)
                shut = set()
                if domains:
                    told = np.zeros(len(aliases), bool)
                    told[standing(guarding, t)] = True
                    shut = {k for k, d in enumerate(domains) if not told[d].any()}
                hit, count, strong = found(here, own, shut)
                pick = best(hit, count, limit)
                hit, count, strong = hit[pick], count[pick], strong[pick]
                other = len(hit)
                if len(own):
                    c, s = cards.counts(own, mark)
                    keep = c >= max(1, own_least)
                    own, c, s = own[keep], c[keep], s[keep]
                    pick = best(own, c, own_limit)
                    hit, count, strong = np.concatenate([hit, own[pick]]), np.concatenate([count, c[pick]]), np.concatenate([strong, s[pick]])
                mark[here] = 0
                if len(hit):
                    out.append((b[doc].slice(i, 1), hit, count, strong, np.arange(len(hit)) >= other))
                    size += len(hit)
                if size >= BATCH_ROWS:
                    yield _rows(out, cards.ids, cards.sure, schema.names)
                    out, size = [], 0
        if out:
            yield _rows(out, cards.ids, cards.sure, schema.names)

    def one(shared: Broadcast) -> DataFrame:
        return docs.select(*columns).mapInArrow(lambda batches: scanned(_cards(shared.value), batches), schema)

    def sent(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= MET_CARDS:
                    yield from scanned(Cards(pa.Table.from_batches(held)), shared.value.to_batches())
                    held, size = [], 0
            if size:
                yield from scanned(Cards(pa.Table.from_batches(held)), shared.value.to_batches())

        return grouped.mapInArrow(run, schema)

    spark, texts = words.sparkSession, docs.select(*columns)
    if docs.select(doc).limit(FEW_TEXTS + 1).count() <= FEW_TEXTS and (texts.agg(F.sum(F.length(text))).first()[0] or 0) <= FEW_CHARACTERS:
        path = shared_path(spark, "met")  # written: the cards are made once, however often the result is read
        sent(spark.sparkContext.broadcast(texts.toArrow())).write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    path = shared_path(spark, "cards")  # made once: they are measured, then sent
    grouped.write.parquet(path)
    grouped = spark.read.schema(grouped.schema).parquet(path)
    rows, all_words = (grouped.agg(F.count("*").alias("cards"), F.sum(F.size("words")).alias("words")).first() or (0, 0))[:2]
    n = max(1, -(-rows // BLOCK_CARDS), -(-(all_words or 0) // (BLOCK_WORDS * CARD_SIZE)))
    return blocks(grouped, "card_id", n, lambda df: spark.sparkContext.broadcast(df.toArrow()), one)


def _rows(out: list[tuple], ids: pa.Array, sure: pa.Array, names: list[str]) -> pa.RecordBatch:
    docs = pa.concat_arrays([d for d, *_ in out]).take(pa.array(np.repeat(np.arange(len(out)), [len(x[1]) for x in out])))
    pick, counts, strong, own = (np.concatenate([x[k] for x in out]) for k in range(1, 5))
    return pa.RecordBatch.from_arrays([docs, ids.take(pa.array(pick)), sure.take(pa.array(pick)), pa.array(counts.astype(np.int64)), pa.array(strong.astype(np.int32)), pa.array(own)], names)
