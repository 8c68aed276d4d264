"""Toxicity by weak supervision: lexicons and patterns vote or abstain, a generative model with a tree of correlations
estimates how far they can be trusted, and a linear classifier is trained on its posterior labels.

Besides the lexicons below there is a learned one: beginnings of words, and words, that are far more frequent in labelled toxic
texts than in labelled clean ones. Everything is learned from rows whose crc32 of the id, modulo FOLDS, is not 0.
Texts are read twice: the labelled sample, and all of them for the counts of hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import Stash, cut, prepare

FOLDS = 5
#: Bounds of what is fitted on a sample by hash: labelled toxic and clean rows for the learned lexicon, and rows for the classifier.
TOXIC_SAMPLE, CLEAN_SAMPLE, TRAIN_SAMPLE = 4000, 8000, 20_000
#: Entries of the learned lexicon at most, and the lengths of beginnings of words.
ENTRIES, BEGINNINGS = 256, range(4, 9)
#: Uses of an entry in one text that count, so that a text of one repeated word decides little.
USES = 3
#: A learned entry is in so many toxic texts at least, in this share of them, and this unlikely (G statistic) without a link.
LEAST_TEXTS, LEAST_SHARE, LEAST_G, LEAST_RATIO = 3, 0.004, 18.0, 1.5

# Words of the lexicons, whole words in lower case, English, German, French and Spanish.
LEXICONS = {
    "insults": "idiot idiots moron morons imbecile loser losers clown clowns scum trash fool jerk trottel depp versager abschaum dummkopf crétin abruti raclure ordure imbécil idiota payaso escoria",
    "contempt": "pathetic worthless disgusting stupid useless dumb filthy erbärmlich wertlos widerlich dumm pathétique stupide dégoûtant minable patético inútil asqueroso estúpido",
    "profanity": "damn crap shit bullshit bastard asshole scheiße verdammt arschloch merde putain connard salaud mierda cabrón joder",
    "threats": "kill hurt destroy strangle die umbringen töten schlagen tuer crever frapper matar morir golpear",
    "hate": "vermin subhuman parasites filth ungeziefer parasiten vermine parasite sabandijas parásitos basura",
}
YOU = re.compile(r"\b(?:you|your|you're|ur|du|dich|dein|ihr|tu|toi|vous|ton|tú|usted|eres|ti)\b")
WORD = re.compile(r"[^\W\d_]+")
TIERS = (4.0, 2.5)  # log ratios from which a learned entry is strong, or medium; below it is weak
GROUPS = (*LEXICONS, "strong", "medium", "weak", "attack", "shouting")
VOTERS = (*GROUPS, "learned_twice", "dense", "two_entries", "no_lexicon", "no_learned", "hardly_any")
#: Voters for clean texts; all others vote toxic. A voter that does not vote abstains.
CLEAN_VOTERS = frozenset(("no_lexicon", "no_learned", "hardly_any"))


@dataclass
class Entry:
    text: str
    whole: bool
    group: str


def held_out(id_col: Column) -> Column:
    """True for rows that nothing is learned from; a null id is one of them."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, toxic of the learning folds: one row an id; 1 wins over 0, nulls don't count."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))


def _beginnings(text: str) -> Counter[str]:
    """How often a text has each word (with a blank behind it) and each beginning of words, at most USES times."""
    found: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        found[word + " "] += n
        for k in BEGINNINGS:
            if len(word) >= k:
                found[word[:k]] += n
    return Counter({w: min(n, USES) for w, n in found.items()})


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the smallest hash of a text's runs of five words (of the whole text if it has fewer)."""
    for b in batches:
        least = []
        for text in b.column("text").to_pylist():
            words = text.split()
            least.append(min(xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))) >> 1)
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("text"), pa.array(least, pa.int64())], ["toxic", "text", "sketch"])


def learn_lexicon(docs: DataFrame, known: DataFrame) -> list[Entry]:
    """Entries learned from docs(id, text) and known(id, toxic), at most TOXIC_SAMPLE and CLEAN_SAMPLE rows of a label.

    Of texts that share the smallest hash of their runs of five words, which near copies mostly do, one counts.
    """
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    picked = pick(1, TOXIC_SAMPLE).unionByName(pick(0, CLEAN_SAMPLE))
    d = docs.join(F.broadcast(picked), "id").where("text is not null")
    sample = cut(d.mapInArrow(_sketched, "toxic int, text string, sketch long").groupBy("sketch", "toxic").agg(F.min("text").alias("text")))
    toxic, clean = (sample.where(F.col("toxic") == y).select("text") for y in (1, 0))
    def count(wanted: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses, texts, total = Counter(), Counter(), 0
            for b in batches:
                for text in b.column(0).to_pylist():
                    found = _beginnings(text)
                    total += 1
                    if wanted is not None:
                        found = {w: n for w, n in found.items() if w in wanted}
                    uses.update(found)
                    texts.update(found.keys())
            names = list(uses)
            yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*(uses[w] for w in names), total]), pa.array([*(texts[w] for w in names), 1 << 40])], ["entry", "uses", "texts"])

        return run

    def counted(df: DataFrame, least: float, wanted: set[str] | None = None) -> dict[str, tuple[int, int]]:
        g = df.mapInArrow(count(wanted), "entry string, uses long, texts long").groupBy("entry").agg(F.sum("uses").alias("uses"), F.sum("texts").alias("texts"))
        return {r["entry"]: (r["uses"], r["texts"]) for r in g.where(F.col("texts") >= least).collect()}

    bad = counted(toxic, max(LEAST_TEXTS, LEAST_SHARE * toxic.count()))
    good = counted(clean, 0, set(bad))
    all_bad, all_good = max(1, bad.pop("", (1, 0))[0]), max(1, good.pop("", (1, 0))[0])
    ranked = []
    for text, (uses, _) in bad.items():
        other = good.get(text, (0, 0))[0]
        ratio = np.log((uses + 0.5) / all_bad) - np.log((other + 0.5) / all_good)
        share = (uses + other) / (all_bad + all_good)
        g = 2 * (uses * np.log(uses / (share * all_bad)) + (other * np.log(other / (share * all_good)) if other else 0.0))
        if ratio >= LEAST_RATIO and g >= LEAST_G:
            ranked.append((-uses * ratio, len(text), text, ratio))
    kept: dict[str, float] = {}
    for _, _, text, ratio in sorted(ranked):
        inside = [kept[text[:k]] for k in BEGINNINGS if text[:k] in kept and k < len(text)]
        if len(kept) < ENTRIES and (not inside or ratio > max(inside) + 0.7):
            kept[text] = ratio
    tier = lambda r: "strong" if r >= TIERS[0] else "medium" if r >= TIERS[1] else "weak"
    return [Entry(t.rstrip(" "), t.endswith(" "), tier(r)) for t, r in kept.items()]


def hit_counts(docs: DataFrame, entries: list[Entry]) -> DataFrame:
    """docs(id, text) -> id, n_words, votes (bits of VOTERS), groups (hits of each of GROUPS), entry, uses (entries of the list hit).

    An entry is hit at the beginning of a word. Null texts have no words.
    """
    every = [Entry(w, True, g) for g, ws in LEXICONS.items() for w in ws.split()]
    first = len(every)
    every += entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text: dict[str, list[int]] = {}
        for k, e in enumerate(every):
            by_text.setdefault(e.text, []).append(k)
        machine = ahocorasick.Automaton()
        for text, ks in by_text.items():
            machine.add_word(text, (len(text), ks))
        machine.make_automaton()
        at = {g: k for k, g in enumerate(GROUPS)}
        for b in batches:
            out: dict[str, list] = {"n_words": [], "votes": [], "groups": [], "entry": [], "uses": []}
            for text in b.column("text").to_pylist():
                low = (text or "").lower()
                n = len(low.split())
                groups, uses = [0] * len(GROUPS), Counter()
                for end, (size, ks) in machine.iter(low):
                    start = end - size + 1
                    if start and low[start - 1].isalpha():
                        continue
                    whole = end + 1 == len(low) or not low[end + 1].isalpha()
                    for k in ks:
                        if whole or not every[k].whole:
                            groups[at[every[k].group]] += 1
                            if k >= first:
                                uses[k - first] += 1
                            if every[k].group in ("insults", "contempt", "strong") and YOU.search(low[max(0, start - 30) : end + 31]):
                                groups[at["attack"]] += 1
                if low.count("!") * 10 > n:
                    letters = re.sub(r"[^A-Za-z]+", "", text)
                    groups[at["shouting"]] = int(sum(map(str.isupper, letters)) * 2 > len(letters))
                out["n_words"].append(n)
                out["groups"].append(groups)
                out["entry"].append(list(uses.keys()))
                out["uses"].append(list(uses.values()))
                out["votes"].append(votes(n, dict(zip(GROUPS, groups, strict=True)), len(uses)))
            kinds = {"n_words": pa.int64(), "votes": pa.int32(), "groups": pa.list_(pa.int32()), "entry": pa.list_(pa.int32()), "uses": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(out[c], t) for c, t in kinds.items())], ["id", *kinds])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, votes int, groups array<int>, entry array<int>, uses array<int>")


def votes(n_words: int, hits: dict[str, int], n_entries: int) -> int:
    """One bit a voter: its vote, or 0 for abstaining."""
    learned = hits["strong"] + hits["medium"] + hits["weak"]
    lexicon = sum(hits[g] for g in LEXICONS)
    cast = {g: hits[g] > 0 for g in GROUPS} | {
        "learned_twice": hits["strong"] + hits["medium"] > 1,
        "dense": learned > 1 and learned * 100 >= n_words,
        "two_entries": n_entries > 1,
        "no_lexicon": lexicon == 0,
        "no_learned": learned == 0,
        "hardly_any": learned + lexicon <= 1 and n_words >= 20,
    }
    return sum(1 << k for k, v in enumerate(VOTERS) if cast[v])


class LabelModel:
    """P(toxic, votes): two classes, and within a class a tree of dependences between voters (Chow and Liu).

    Fitted by expectation-maximisation over the histogram of votes, at most 2 ** len(VOTERS) rows; rows with a known
    label keep it, and those without weigh no more than those with one in all. Pseudo-counts start from voters
    that are mostly right, and keep the classes from changing places.
    """

    def __init__(self, histogram: dict[int, tuple[float, float, float]], rounds: int = 60):
        """histogram: votes -> rows without a label, clean, toxic."""
        m = len(VOTERS)
        masks = np.array(sorted(histogram), np.int64)
        self.v = ((masks[:, None] >> np.arange(m)) & 1).astype(float)
        counts = np.array([histogram[x] for x in masks.tolist()], float).reshape(-1, 3)
        known = counts[:, 1:].sum()
        free = counts[:, 0] * (min(1.0, known / max(1.0, counts[:, 0].sum())) if known >= 100 else 1.0)
        total = max(1.0, free.sum() + known)
        right = np.array([[0.9 if x in CLEAN_VOTERS else 0.02, 0.1 if x in CLEAN_VOTERS else 0.5] for x in VOTERS]).T
        self.prior = np.array([0.9, 0.1])
        self.start, self.weight = right, max(1.0, 0.002 * total)
        self.parent = np.full(m, -1)
        self.table = np.stack([right, right], 1)  # class, parent's vote, voter: P(votes)
        for _ in range(rounds):
            q = self.posterior(self.v)
            w = np.stack([free * (1 - q) + counts[:, 1], free * q + counts[:, 2]])
            before = self.table
            self._maximise(w)
            if np.abs(before - self.table).max() < 1e-7:
                break
        self.accuracies = self._accuracies()

    def _maximise(self, w: np.ndarray) -> None:
        m = len(VOTERS)
        both = np.empty((2, 2, 2, m, m))  # class, vote of row, vote of column
        for y in (0, 1):
            p, n = self.start[y], self.weight * self.prior[y]
            a = (self.v * w[y][:, None]).T @ self.v + n * np.outer(p, p)
            one = (self.v * w[y][:, None]).sum(0) + n * p
            both[y, 1, 1], both[y, 1, 0], both[y, 0, 1] = a, one[:, None] - a, one[None] - a
            both[y, 0, 0] = w[y].sum() + n - one[:, None] - one[None] + a
        both = np.maximum(both, 1e-9)
        mass = both.sum((1, 2))[:, 0, 0]
        self.prior = mass / mass.sum()
        share = both / both.sum((1, 2), keepdims=True)
        rows, columns = share.sum(2, keepdims=True), share.sum(1, keepdims=True)
        self.bond = np.einsum("y,yabjk->jk", self.prior, share * np.log(share / (rows * columns)))
        np.fill_diagonal(self.bond, -1)
        parent, best = np.full(m, -1), self.bond[0].copy()
        source, left = np.zeros(m, int), set(range(1, m))
        while left:
            k = max(left, key=lambda j: (best[j], -j))
            parent[k] = source[k]
            left.discard(k)
            closer = self.bond[k] > best
            best[closer], source[closer] = self.bond[k][closer], k
        self.parent = parent
        table = np.empty((2, 2, m))
        for k in range(m):
            j = parent[k] if parent[k] >= 0 else k
            for y in (0, 1):
                if parent[k] < 0:
                    table[y, :, k] = rows[y, 1, 0, k, 0 if k else 1]
                else:
                    for a in (0, 1):
                        table[y, a, k] = both[y, a, 1, j, k] / (both[y, a, 1, j, k] + both[y, a, 0, j, k])
        self.table = np.clip(table, 1e-6, 1 - 1e-6)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows of votes."""
        up = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0).astype(int)
        odds = np.log(self.prior)[:, None] + np.zeros((2, len(v)))
        for y in (0, 1):
            p = self.table[y][up, np.arange(v.shape[1])]
            odds[y] += np.where(v > 0, np.log(p), np.log1p(-p)).sum(1)
        return 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -500, 500)))

    def _accuracies(self) -> dict[str, float]:
        """P(the voter is right | it votes), from the fitted tree's margins."""
        m, out, margin = len(VOTERS), {}, np.full((2, len(VOTERS)), np.nan)
        while np.isnan(margin).any():
            for k in range(m):
                j = self.parent[k]
                for y in (0, 1):
                    if j < 0:
                        margin[y, k] = self.table[y, 0, k]
                    else:
                        margin[y, k] = margin[y, j] * self.table[y, 1, k] + (1 - margin[y, j]) * self.table[y, 0, k]
        for k, name in enumerate(VOTERS):
            clean, toxic = self.prior * margin[:, k]
            out[name] = float((clean if name in CLEAN_VOTERS else toxic) / (clean + toxic))
        return out


def design(n_words: np.ndarray, groups: np.ndarray, row: np.ndarray, entry: np.ndarray, uses: np.ndarray, n_entries: int) -> np.ndarray:
    """The classifier's inputs: of each group and entry whether it is there and its rate, and a constant."""
    n = np.maximum(1, n_words)[:, None]
    rate = np.minimum(1.0, 40 * groups / n)
    own = np.zeros((len(n_words), n_entries))
    own[row, entry] = np.minimum(1.0, 40 * uses / n[row, 0])
    return np.hstack([np.ones((len(n_words), 1)), groups > 0, groups > 1, rate, own])


def train_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Logistic regression on labels between 0 and 1 by Newton steps; the constant has no penalty but a trace."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w * w).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        w, gain, now = w + size * step, now - new, new
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    return w


def _inputs(table: pa.Table | pa.RecordBatch, n_entries: int) -> np.ndarray:
    flat = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
    groups = flat("groups").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(GROUPS))
    lengths = np.array(flat("entry").value_lengths())
    row = np.repeat(np.arange(len(lengths)), lengths)
    return design(table.column("n_words").to_numpy(), groups, row, flat("entry").flatten().to_numpy(zero_copy_only=False), flat("uses").flatten().to_numpy(zero_copy_only=False), n_entries)


@dataclass
class Fitted:
    entries: list[Entry]
    label_model: LabelModel
    weights: np.ndarray


def fit(hits: DataFrame, known: DataFrame, entries: list[Entry]) -> Fitted:
    """The label model on all rows of the learning folds, and the classifier on posterior labels of TRAIN_SAMPLE of them by hash.

    hits: of hit_counts, read several times. The posterior of a row with a known label is that label.
    """
    learn = hits.where(~held_out(F.col("id")))
    every = {r["votes"]: r["n"] for r in learn.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_label = learn.select("id", "votes").join(known, "id").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {(r["votes"], r["toxic"]): r["n"] for r in by_label}
    model = LabelModel({v: (n - seen.get((v, 0), 0) - seen.get((v, 1), 0), seen.get((v, 0), 0), seen.get((v, 1), 0)) for v, n in every.items()})
    rows = learn.orderBy(F.xxhash64("id"), "id", "n_words", "votes").limit(TRAIN_SAMPLE)
    rows = cut(rows)
    truth = known.join(F.broadcast(rows.select("id").distinct()), "id").select("id", "toxic")
    got = rows.join(F.broadcast(truth), "id", "left").toArrow()
    if not got.num_rows:
        return Fitted(entries, model, np.zeros(1 + 3 * len(GROUPS) + len(entries)))
    cast = (got.column("votes").to_numpy()[:, None] >> np.arange(len(VOTERS))) & 1
    label = got.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    return Fitted(entries, model, train_linear(_inputs(got, len(entries)), np.where(np.isnan(label), model.posterior(cast.astype(float)), label)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, Fitted]:
    """(id, held_out, score, n_words) of every row of docs, and what was fitted.

    labels(id, label) may be empty, repeat ids or name ids that are not there. Null and empty texts have no hits and get the score of
    a text without any; null ids are held out; repeated rows are scored each. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labelled(labels, id_col, label_col)
    entries = learn_lexicon(d, known)
    hits = Stash(hit_counts(d, entries))
    try:
        fitted = fit(hits.df, known, entries)
        w, n_entries = fitted.weights, len(entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = 1 / (1 + np.exp(-np.clip(_inputs(b, n_entries) @ w, -500, 500)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p), b.column("n_words")], ["id", "score", "n_words"])

        kind = hits.df.schema["id"].dataType.simpleString()
        scored = hits.df.mapInArrow(run, f"id {kind}, score double, n_words long")
        return cut(scored.select("id", held_out(F.col("id")).alias("held_out"), "score", "n_words")), fitted
    finally:
        hits.drop()


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
