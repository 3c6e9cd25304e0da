"""Mapping free-entered values to a canonical list: BK-trees over the list under the Levenshtein distance.

Each distinct value is read into possible readings (`readings`): case, blanks, accents and marks that say nothing about the
taxon are folded away, authors, notes and qualifiers of sense are cut off, and the parts are put in the usual order. The
readings are looked up in a BK-tree over the list's folded names; the triangle inequality prunes subtrees and every entry
within the threshold comes back. `choose` then takes the one entry the value stands for, or none.

A value is first asked for with radius 0; the names that have no entry at all there are asked for with the whole threshold.
That gives the same winners as asking all of them with the threshold, as any entry that is written the same way goes before
all others.

A list of up to `broadcast_entries` entries is one broadcast tree; a longer one is cut into shards by entry. Each task then
builds the tree of one shard, once, and streams its share of the values through it; every value is looked up in every shard
and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of one tree: a list of up to this many is broadcast (some 10 MB), a longer one is cut into shards of this size.
BROADCAST_ENTRIES = 50_000
#: Every entry within this Levenshtein distance of a reading is a candidate.
THRESHOLD = 3
#: Values are looked up in batches of this many, so that the distances of one tree level are one numpy call.
BATCH = 512

#: Words that mark a rank below species, by the rank they stand for.
RANK_WORDS = {"subsp": "subsp", "ssp": "subsp", "subspecies": "subsp", "var": "var", "v": "var", "variety": "var", "varietas": "var", "f": "f", "fo": "f", "form": "f", "forma": "f", "subvar": "subvar", "subf": "subf", "nothosubsp": "subsp", "nothovar": "var"}
#: What stands for a species that was not determined.
UNDETERMINED = {"sp", "spp", "spec", "species", "indet"}


# --- bit-parallel edit distance -----------------------------------------------------------------------------------------


class Codes:
    """Texts as rows of small integers over the list's alphabet; characters outside it are code 0."""

    def __init__(self, names: list[str]):
        self.index = {c: i + 1 for i, c in enumerate(sorted(set("".join(names))))}

    def rows(self, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.full((len(texts), width), -1, np.int16)
        code = self.index.get
        for i, t in enumerate(texts):
            out[i, : len(t)] = [code(c, 0) for c in t]
        return out, np.array([len(t) for t in texts], np.int64)


class BKTree:
    """A BK-tree in arrays, looked up level by level for many queries at once.

    Distances are Levenshtein distances by Myers' bit-vectors, a lane per (query, node); names longer than 64 characters
    are compared by the plain recurrence.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.codes = Codes(names)
        n = len(names)
        self.length = np.array([len(x) for x in names], np.int64)
        self.masks = np.zeros((n, len(self.codes.index) + 1), np.uint64)
        for i, name in enumerate(names):
            if len(name) <= 64:
                for j, c in enumerate(name):
                    self.masks[i, self.codes.index[c]] |= np.uint64(1 << j)
        self.children: list[np.ndarray] = []
        self.edges: list[np.ndarray] = []
        self._grow()

    def _grow(self) -> None:
        """Insert all names level by level: a node's followers are split by their distance to it."""
        n = len(self.names)
        self.children = [np.empty(0, np.int64)] * n
        self.edges = [np.empty(0, np.int64)] * n
        self.root = 0 if n else -1
        todo = [(0, np.arange(1, n))] if n else []
        while todo:
            nodes = np.concatenate([np.full(len(m), node) for node, m in todo]) if todo else np.empty(0, np.int64)
            member = np.concatenate([m for _, m in todo])
            d = self.distances([self.names[m] for m in member], np.arange(len(member)), nodes) if len(member) else np.empty(0, np.int64)
            nxt, at = [], 0
            for node, m in todo:
                dist = d[at : at + len(m)]
                at += len(m)
                order = np.argsort(dist, kind="stable")
                values, starts = np.unique(dist[order], return_index=True)
                parts = np.split(m[order], starts[1:]) if len(m) else []
                self.children[node] = np.array([p[0] for p in parts], np.int64)
                self.edges[node] = values.astype(np.int64) if len(m) else np.empty(0, np.int64)
                nxt += [(int(p[0]), p[1:]) for p in parts if len(p) > 1]
            todo = nxt

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.codes.rows(texts, max((len(t) for t in texts), default=1) or 1)

    def distances(self, texts: list[str], which: np.ndarray, nodes: np.ndarray, coded: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Levenshtein distances of texts[which[i]] to names[nodes[i]]."""
        rows, lengths = coded or self.coded(texts)
        out = np.empty(len(nodes), np.int64)
        m = self.length[nodes]
        short = (m > 0) & (m <= 64)
        for i in np.flatnonzero(~short):
            out[i] = plain_distance(texts[which[i]], self.names[nodes[i]])
        pick = np.flatnonzero(short)
        if len(pick):
            out[pick] = self._myers(rows[which[pick]], lengths[which[pick]], nodes[pick])
        return out

    def _myers(self, text: np.ndarray, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        text, lengths, nodes = text[order], lengths[order], nodes[order]
        m = self.length[nodes].astype(np.uint64)
        last = np.uint64(1) << (m - np.uint64(1))
        pv, mv = np.full(len(nodes), ~np.uint64(0)), np.zeros(len(nodes), np.uint64)
        score = self.length[nodes].copy()
        one = np.uint64(1)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            k = int(np.searchsorted(-lengths, -j, side="left"))  # lanes whose text is longer than j
            eq = self.masks[nodes[:k], text[:k, j]]
            p, q = pv[:k], mv[:k]
            xv = eq | q
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            score[:k] += ((ph & last[:k]) != 0).astype(np.int64) - ((mh & last[:k]) != 0)
            ph = (ph << one) | one
            pv[:k], mv[:k] = (mh << one) | ~(xv | ph), ph & xv
        back = np.empty(len(nodes), np.int64)
        back[order] = score
        return back

    def within(self, texts: list[str], limit: int) -> list[list[tuple[int, int]]]:
        """For each text every (distance, name index) within limit."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if self.root < 0 or not texts:
            return found
        # No name is longer than the longest one, so a text beyond that by more than the limit has no match.
        longest = int(self.length.max()) + limit
        which = np.array([i for i, t in enumerate(texts) if len(t) <= longest], np.int64)
        texts = [t if len(t) <= longest else "" for t in texts]
        nodes = np.full(len(which), self.root, np.int64)
        coded = self.coded(texts)
        while len(nodes):
            d = self.distances(texts, which, nodes, coded)
            for i in np.flatnonzero(d <= limit):
                found[which[i]].append((int(d[i]), int(nodes[i])))
            w2, n2 = [], []
            order = np.argsort(nodes, kind="stable")
            starts = np.flatnonzero(np.diff(nodes[order], prepend=-1))
            for here in np.split(order, starts[1:]):
                child, edge = self.children[nodes[here[0]]], self.edges[nodes[here[0]]]
                if len(child):
                    qi, ci = np.nonzero(np.abs(edge[None, :] - d[here][:, None]) <= limit)
                    w2.append(which[here][qi])
                    n2.append(child[ci])
            which = np.concatenate(w2) if w2 else np.empty(0, np.int64)
            nodes = np.concatenate(n2) if n2 else np.empty(0, np.int64)
        return found


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


# --- readings of a value ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reading:
    """One way to read a value: genus ('' or an initial when abbreviated), epithets without rank words, rank, author's words."""

    genus: str
    epithets: tuple[str, ...]
    rank: str
    author: tuple[str, ...] = ()
    second: bool = False  # yields to another reading that fits as well

    @property
    def abbreviated(self) -> bool:
        return len(self.genus) == 1

    @property
    def key(self) -> str:
        return " ".join(self.epithets if self.abbreviated else (self.genus, *self.epithets))


def fold(text: str) -> str:
    """Lower case without accents, one blank between words; letters that a reader would type for ß, ł, ø, æ, œ and the like."""
    text = unicodedata.normalize("NFKD", text.replace("_", " ").replace("\xad", ""))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    for a, b in (("ß", "ss"), ("ł", "l"), ("ø", "o"), ("æ", "ae"), ("œ", "oe"), ("đ", "d"), ("ı", "i")):
        text = text.replace(a, b)
    return " ".join(text.split())


_NOTES = re.compile(r"\[[^\]]*\]|\((?:in|det|cf|cult|juv|ster|fl|fr)\b[^)]*\)|[!*†#?\"]")
_SENSE = re.compile(r"(?:^|\s)(?:auct\.?(?:\s.*)?|non\s.*|nec\s.*|sensu\s+(?:lato|stricto|latiore|auct)\.?.*|sensu\s.*|emend\.?\s.*|s\.?\s?l(?:at)?\.?|s\.?\s?str\.?|agg\.?|aggr\.?|coll\.?|p\.\s?p\.)(?=\s|$|[,;.])")
_OCR = str.maketrans({"1": "l", "0": "o", "5": "s"})
_WORD = re.compile(r"^[a-z][a-z-]*[a-z]$")


def readings(value: str, authors: frozenset[str]) -> list[Reading]:
    """The possible readings of a free-entered value, the likeliest first; none for a genus or for no taxon at all."""
    text = fold(value)
    for _ in range(3):
        text = " ".join(_SENSE.sub(" ", " ".join(_NOTES.sub(" ", text).split())).split()).strip(" ,;.:")
    if not text:
        return []
    swapped = re.match(r"^([a-z0-9-]+(?:[ .]+[a-z0-9.-]+)*?)\s*,\s*([a-z0-9-]{2,}\.?)$", text)
    if swapped:
        text = f"{swapped[2]} {swapped[1]}"
    text = re.sub(r"^([a-z0-9-]+\.?)\s*\([a-z0-9.-]+\)\s+(?=[a-z])", r"\1 ", text)
    text = re.sub(r"[×✕]", " ", text)
    tokens = [t for t in re.split(r"[\s,;]+", re.sub(r"([a-z])\.(?=[a-z]{3})", r"\1. ", text)) if t]
    tokens = [t for i, t in enumerate(tokens) if not (t == "x" and 0 < i) and t not in ("cf.", "cf", "aff.", "aff")]
    if not tokens or tokens[0] in ("x",):
        tokens = tokens[1:]
    if len(tokens) < 2:
        return []
    genus = tokens[0].rstrip(".").translate(_OCR)
    rest = tokens[1:]
    if rest[0].rstrip(".") in UNDETERMINED or not _WORD.match(_letters(rest[0])) or not genus.replace("-", "").isalpha():
        return []
    out: list[Reading] = []
    species = _letters(rest[0])
    capital = _capitals(value)
    if species in capital:  # every word has one
        capital = frozenset()
    # The rank word stands behind the species or behind its author.
    k = next((k for k in range(1, len(rest) - 1) if rest[k].rstrip(".") in RANK_WORDS and _WORD.match(_letters(rest[k + 1])) and (k == 1 or _ranks_epithet(rest[k + 1], capital))), 0)
    if k:
        out.append(Reading(genus, (species, _letters(rest[k + 1])), RANK_WORDS[rest[k].rstrip(".")], _author(rest[k + 2 :] + rest[1:k])))
    # f. after an author may mean his son, where no capitals tell.
    son = k > 1 and rest[k].rstrip(".") in ("f", "v") and not _mixed(value)
    author = _author(rest[1:])
    if k == 1:
        pass
    elif author and _WORD.match(_letters(rest[1])) and rest[1].strip("().") not in authors and not rest[1].startswith("(") and rest[1] not in _JOINING:
        # A third word that is no author: an epithet below species whose rank was not typed.
        if not k or son or not (rest[1].endswith(".") or _letters(rest[1]) in capital):
            out.append(Reading(genus, (species, _letters(rest[1])), "", author[1:]))
        if (not k or son) and (rest[1].endswith(".") or _letters(rest[1]) in capital):
            out.append(Reading(genus, (species,), "", author, son or not rest[1].endswith(".")))
    elif not k or son:
        out.append(Reading(genus, (species,), "", author, son))
    return out


#: Words between authors.
_JOINING = ("ex", "et", "in", "&")


def _author(tokens: list[str]) -> tuple[str, ...]:
    return tuple(_letters(t.strip("()&.,")) for t in tokens if t.strip("()&.,"))


def _ranks_epithet(token: str, capital: frozenset[str]) -> bool:
    return token.rstrip(".") not in RANK_WORDS and token not in _JOINING and _letters(token) not in capital


def _cased(value: str) -> list[str]:
    return [w for w in re.split(r"[\s,;_&()]+", unicodedata.normalize("NFKD", value)) if w]


def _capitals(value: str) -> frozenset[str]:
    """The folded words after the first that are written with a capital only."""
    words = [(_letters(fold(w)), w[0].isupper()) for w in _cased(value)[1:]]
    return frozenset(w for w, up in words if up) - {w for w, up in words if not up}


def _mixed(value: str) -> bool:
    """Whether the first word has a capital and the second none."""
    words = _cased(value)
    return len(words) > 1 and words[0][0].isupper() and words[1][0].islower()


def _letters(token: str) -> str:
    return token.strip("().,;:'").translate(_OCR)


# --- choosing an entry --------------------------------------------------------------------------------------------------


def sounds(key: str) -> str:
    """The key with the spellings of one sound and the endings of gender and case made one."""
    words = key.replace("ph", "f").replace("y", "i").split(" ")
    return " ".join(re.sub(r"(?:us|um|ae|is|a|i|e)$", "", w) if i or len(words) == 1 else w for i, w in enumerate(words))


def transposing_distance(a: str, b: str, limit: int) -> int:
    """Edits with swapped neighbours counted once (not a metric: used to rank candidates only)."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # What both begin and end with costs nothing.
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


def author_words(authorship: str | None) -> frozenset[str]:
    return frozenset(w.strip("().&,") for w in fold(authorship or "").split()) - {""}


class _Asked:
    """Stands for a set of author words and keeps what it was asked for."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __contains__(self, word: str) -> bool:
        self.words.append(word)
        return False


def doubtful_word(value: str | None) -> str | None:
    """The word of a value that is an author or an epithet, depending on whether the list knows it as an author."""
    asked = _Asked()
    readings(value or "", asked)
    return asked.words[0] if asked.words else None


class Index:
    """The trees over one list (or shard): entries are (ref_id, name, authorship)."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.ids, self.read, self.authors, folded = [], [], [], []
        vocabulary = set()
        for ref_id, name, authorship in entries:
            words = author_words(authorship)
            vocabulary |= words
            got = readings(name or "", frozenset())
            if got and ref_id is not None:
                self.ids.append(int(ref_id))
                self.read.append(got[0])
                self.authors.append(words)
                folded.append(got[0].key)
        self.vocabulary = frozenset(vocabulary)
        self.full = BKTree(folded)
        self.epithets = BKTree([" ".join(r.epithets) for r in self.read])
        self.sounds = [sounds(k) for k in folded]
        self.sounds_short = [sounds(" ".join(("", *r.epithets)).strip()) for r in self.read]

    def best(self, values: list[str], authors: list[frozenset[str]] | None = None) -> list[list[tuple[int, int]]]:
        """For each value the best candidates as (score, ref_id): none, one, or two when several are equally good.

        authors: the words that are known as authors, by value, where this index holds only a part of the list.
        """
        authors = authors or [self.vocabulary] * len(values)
        out: list[list[tuple[int, int]]] = []
        for at in range(0, len(values), BATCH):
            out += self._batch(values[at : at + BATCH], authors[at : at + BATCH])
        return out

    def _batch(self, values: list[str], authors: list[frozenset[str]]) -> list[list[tuple[int, int]]]:
        read = [(i, r) for i, v in enumerate(values) for r in readings(v, authors[i])]
        scored: list[dict[int, int]] = [{} for _ in values]
        for limit in (0, THRESHOLD):
            for short, tree in ((False, self.full), (True, self.epithets)):
                mine = [(i, r) for i, r in read if r.abbreviated == short and not (limit and scored[i])]
                # Equal keys are looked up once.
                keys = list(dict.fromkeys(r.key for _, r in mine))
                hits = dict(zip(keys, tree.within(keys, limit)))
                for i, r in mine:
                    self._score(scored[i], r, hits[r.key])
            # What is written like an entry is done: no other entry can come before it.
            done = {i for i, s in enumerate(scored) if s}
            read = [(i, r) for i, r in read if i not in done]
        out = []
        for s in scored:
            low = min(s.values(), default=None)
            out.append([(low, self.ids[j]) for j in sorted(j for j, x in s.items() if x == low)[:2]] if s else [])
        return out

    def _score(self, scores: dict[int, int], r: Reading, hits: list[tuple[int, int]]) -> None:
        """Put the entries that a reading hits, with their scores, to those of its value."""
        for d, j in hits:
            entry = self.read[j]
            if len(entry.epithets) != len(r.epithets) or (r.abbreviated and entry.genus[0] != r.genus):
                continue
            cost = 0
            if d:
                shape = sounds(r.key)
                cost = transposing_distance(shape, self.sounds_short[j] if r.abbreviated else self.sounds[j], 2)
                if cost > 1 and d > 2:
                    continue
                cost = min(cost, 2) + 1
            rank_off = int(bool(r.rank and entry.rank and r.rank != entry.rank))
            author_off = int(not (set(r.author) & self.authors[j]))
            score = cost * 1000 + rank_off * 100 + author_off * 10 + 5 * r.second + d
            scores[j] = min(score, scores.get(j, score))


def map_values(values: DataFrame, refs: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """values (value: distinct text) and refs (ref_id, name, authorship) to (value, ref_id): the entry it stands for, or 0.

    Null and blank values and those that several entries fit equally well get 0; repeated entries of the list count once.
    """
    refs = refs.select(F.col("ref_id").cast("long").alias("ref_id"), "name", "authorship").where("ref_id is not null and name is not null").dropDuplicates(["ref_id"])
    n = refs.limit(broadcast_entries + 1).count()
    parallel = values.sparkSession.sparkContext.defaultParallelism
    if n <= broadcast_entries:
        entries = values.sparkSession.sparkContext.broadcast([tuple(r) for r in refs.orderBy("ref_id").collect()])
        token = uuid.uuid4().hex
        # A fixed number of partitions: values are few bytes but much work, and would be put into one task.
        best = values.repartition(parallel).mapInPandas(lambda batches: _look_up(batches, entries, token), "value string, score int, ref_id long")
    else:
        shards = -(-refs.count() // broadcast_entries)
        blocks = -(-parallel // shards)  # as many tasks as run at once, and as many trees
        # Which doubtful words are authors is asked of the whole list, as a shard knows only its own.
        doubtful, words = F.pandas_udf(_doubtful, T.StringType()), F.pandas_udf(_words, T.ArrayType(T.StringType()))
        known = refs.select(F.explode(words("authorship")).alias("word")).distinct()
        asked = values.select("value", doubtful("value").alias("word")).join(known.withColumn("is_author", F.lit(True)), "word", "left")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        at = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        left = asked.select(every(shards).alias("shard"), at("value", blocks).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ref_id"), "value", F.when(F.col("is_author"), F.col("word")).alias("author"))
        right = refs.select(at("ref_id", shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), "ref_id", F.col("name").alias("value"), F.col("authorship").alias("author"))
        together = right.unionByName(left).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "kind", "ref_id")
        best = together.mapInPandas(_look_up_shards, "value string, score int, ref_id long")
    merged = best.groupBy("value").agg(F.min("score").alias("low"), F.collect_set(F.struct("score", "ref_id")).alias("c"))
    winners = F.filter("c", lambda x: (x["score"] == F.col("low")) & (x["ref_id"] > 0))
    return merged.select("value", F.when(F.size(winners) == 1, F.get(winners, F.lit(0))["ref_id"]).otherwise(F.lit(0)).cast("long").alias("ref_id"))


#: The index of the last list that this worker process was sent.
_cache: dict[str, Index] = {}


def _doubtful(values: pd.Series) -> pd.Series:
    return values.map(doubtful_word)


def _words(authorships: pd.Series) -> pd.Series:
    return authorships.map(lambda a: sorted(author_words(a)))


def _rows(values: list[str], index: Index, authors: list[frozenset[str]] | None = None) -> pd.DataFrame:
    """Up to two rows a value; a value without candidate gets ref_id 0 with the worst score."""
    out = [(v, s, r) for v, best in zip(values, index.best([v or "" for v in values], authors)) for s, r in (best or [(1 << 30, 0)])]
    return pd.DataFrame(out, columns=["value", "score", "ref_id"])


def _look_up(batches: Iterator[pd.DataFrame], entries, token: str) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    for pdf in batches:
        if token not in _cache:
            _cache.clear()
            _cache[token] = Index(entries.value)
        yield _rows(pdf["value"].tolist(), _cache[token])


def _look_up_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (shard, block): its entries, of which the tree is built, then its values."""
    at: tuple = ()
    entries: list[tuple[int, str, str | None]] = []
    index: Index | None = None
    for pdf in batches:
        for key, part in pdf.groupby(["shard", "block"], sort=False):
            if key != at:
                at, entries, index = key, [], None
            refs, values = part[part["kind"] == 0], part[part["kind"] == 1]
            entries += zip(refs["ref_id"].astype("int64").tolist(), refs["value"].tolist(), refs["author"].tolist())
            if len(values):
                index = index or Index(entries)
                yield _rows(values["value"].tolist(), index, [frozenset([a]) if isinstance(a, str) else frozenset() for a in values["author"]])
