"""Models of searches: rows (search, term, prob) from queries, clicks, ratings and history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.config import Settings
from adaptlm.operators.em import em_weights
from adaptlm.operators.lm import mixture, normalised, term_counts, truncated, with_background
from adaptlm.sources.store import Store
from adaptlm.sources.tables import checkpointed, sent

DEFAULTS = Settings()


def query_model(queries: DataFrame, key: str, stem: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """Relative frequencies of the query's terms."""
    counts = term_counts(queries, key, stem=stem).withColumn("prob", F.col("tf").cast("double"))
    return truncated(normalised(counts.select(key, "term", "prob"), key, "prob"), key, "prob", s.model_terms, s.model_min_prob)


def weighted_counts(queries: DataFrame, results: DataFrame, doc_counts: DataFrame, key: str, doc: str, s: Settings = DEFAULTS, clicked: float | None = None, pseudo: bool = False, stem: bool = False) -> DataFrame:
    """key, term, f: query terms, and terms of results (key, doc, clicked) by whether they were clicked.

    Results count only where a search has a click, or if pseudo; weights not above 0 go.
    """
    own = term_counts(queries, key, stem=stem).select(key, "term", (F.col("tf") * s.query_weight).alias("f"))
    weight = F.when(F.col("clicked"), F.lit(s.clicked_weight if clicked is None else clicked)).otherwise(F.lit(s.unclicked_weight))
    shown = results.select(key, doc, weight.alias("_w"), F.col("clicked"))
    if not pseudo:
        shown = shown.join(shown.where("clicked").select(key).distinct(), key, "left_semi")
    seen = sent(shown)[0].join(doc_counts, doc).select(key, "term", (F.col("tf") * F.col("_w")).alias("f"))
    return own.unionByName(seen).groupBy(key, "term").agg(F.sum("f").alias("f")).where("f > 0")


def rocchio_model(counts: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """Relative frequencies of weighted counts."""
    return truncated(normalised(counts.select(key, "term", F.col("f").alias("prob")), key, "prob"), key, "prob", s.model_terms, s.model_min_prob)


def mixture_model(counts: DataFrame, probs: DataFrame, default: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """Weighted counts without what the background explains."""
    q = mixture(with_background(counts, probs, default), key, share=s.background_share).where("prob > 0")
    return truncated(q, key, "prob", s.model_terms, s.model_min_prob)


def feedback_model(ratings: DataFrame, doc_counts: DataFrame, probs: DataFrame, default: DataFrame, key: str, doc: str, s: Settings = DEFAULTS) -> DataFrame:
    """From the documents of ratings (key, doc, rating) that are rated Y; query terms take no part."""
    good = ratings.where(F.upper("rating") == "Y").select(key, doc)
    counts = sent(good)[0].join(doc_counts, doc).groupBy(key, "term").agg(F.sum("tf").alias("f"))
    return mixture_model(counts, probs, default, key, s)


def neighbours(scores: DataFrame, session: DataFrame, clicked: DataFrame | None, key: str, other: str, s: Settings = DEFAULTS) -> DataFrame:
    """key, other: members of the same session with clicks, then history (key, other, cosine) with clicks until the cap. Without clicked all searches have clicks.

    The cap is looked at after each history neighbour, so one is taken even beside a full session.
    """
    some = lambda rows: rows if clicked is None else rows.join(clicked.select(F.col(key).alias(other)).distinct(), other, "left_semi")
    members = checkpointed(some(session).where(F.col(key) != F.col(other)).select(key, other).distinct())
    n = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("cosine", 6)), other)
    # so many of the likest hold the cap's even if all members are among them; they are found before anything is shuffled
    most = (n.agg(F.max("_n")).first()[0] or 0) + max(s.max_neighbours, 1)
    past = some(scores.where(F.col("cosine") >= s.min_cosine)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k").join(members, [key, other], "left_anti")
    past = past.withColumn("_k", F.row_number().over(w)).join(n, key, "left").where(F.col("_k") <= F.greatest(s.max_neighbours - F.coalesce("_n", F.lit(0)), F.lit(1)))
    return members.unionByName(past.select(key, other))


def adaptive(keys: DataFrame, evidence: DataFrame, key: str, weight: float = 1.0) -> DataFrame:
    """keys with adaptive: whether a model of a search has evidence (clicks, ratings, neighbours) and a weight for it."""
    some = evidence.select(key).distinct().withColumn("_some", F.lit(weight > 0))
    return keys.join(some, key, "left").withColumn("adaptive", F.coalesce("_some", F.lit(False))).drop("_some")


def history_model(query: DataFrame, pseudo: DataFrame, near: DataFrame, known: DataFrame, probs: DataFrame, default: DataFrame, key: str, other: str, s: Settings = DEFAULTS) -> DataFrame:
    """key, term, prob: the mix of neighbours' models that, beside the query and the background, best explains the pseudo-feedback model.

    query, pseudo: key, term, prob; near: key, other (with members of the session alone it is the session model); known: other, term, prob, the
    models of past searches. EM weighs the components [query, background, neighbours], on the terms of the pseudo model; the query and the background have prior counts.
    A search without neighbours has no model (it is not adaptive).
    """
    near = near.select(key, other).distinct()
    terms = pseudo.join(near, key, "left_semi")
    none = F.lit(None).cast(dict(near.dtypes)[other])
    first = terms.select(key, "term").join(query, [key, "term"]).select(key, F.lit(0).alias("_kind"), none.alias(other), "term", "prob")
    back = with_background(terms.select(key, "term"), probs, default, "prob").select(key, F.lit(1).alias("_kind"), none.alias(other), "term", "prob")
    theirs = near.join(known, other).join(terms.select(key, "term"), [key, "term"]).select(key, F.lit(2).alias("_kind"), other, "term", "prob")
    every = terms.select(key).distinct().withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(other, none).unionByName(near.select(key, F.lit(2).alias("_kind"), other))
    maps = first.unionByName(back).unionByName(theirs).groupBy(key, "_kind", other).agg(F.map_from_entries(F.collect_list(F.struct("term", "prob"))).alias("_m"))
    every = every.alias("e").join(maps.alias("m"), (F.col(f"e.{key}") == F.col(f"m.{key}")) & (F.col("e._kind") == F.col("m._kind")) & F.col(f"e.{other}").eqNullSafe(F.col(f"m.{other}")), "left")
    parts = every.groupBy(F.col(f"e.{key}").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("e._kind").alias("k"), F.col(f"e.{other}").alias("o")))).alias("_who"), F.collect_list(F.struct(F.col("e._kind").alias("k"), F.col(f"e.{other}").alias("o"), F.col("m._m").alias("m"))).alias("_parts"))
    target = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "prob"))).alias("_t"))
    mine = lambda who: F.get(F.filter("_parts", lambda p: (p["k"] == who["k"]) & p["o"].eqNullSafe(who["o"])), F.lit(0))["m"]
    rows = target.join(parts, key).select(
        key, F.col("_who.o").alias("_others"), F.col("_t.prob").alias("target"),
        F.transform("_who", lambda who: F.transform(F.col("_t.term"), lambda t: F.coalesce(F.try_element_at(mine(who), t), F.lit(0.0)))).alias("components"),
        F.transform("_who", lambda who: F.when(who["k"] == 0, s.query_prior).when(who["k"] == 1, s.background_prior).otherwise(0.0)).alias("priors"),
    )
    found = em_weights(F.col("target"), F.col("components"), F.col("priors"), s.em_iterations)
    weights = rows.select(key, F.explode(F.arrays_zip(F.col("_others").alias("o"), found["weights"].alias("w"))).alias("x")).select(key, F.col("x.o").alias(other), F.col("x.w").alias("_w")).where(F.col(other).isNotNull())
    mixed = weights.join(known, other).groupBy(key, "term").agg(F.sum(F.col("_w") * F.col("prob")).alias("prob")).where("prob > 0")
    return truncated(normalised(mixed, key, "prob"), key, "prob", s.model_terms, s.model_min_prob)


def combined_model(long_term: DataFrame, short_term: DataFrame, clicks: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """long * click_prior + short * clicks, normalised; the one alone where the other is empty or has no weight."""
    n = clicks.groupBy(key).agg(F.sum("n").alias("_n"))
    has_long, has_short = long_term.select(key).distinct().withColumn("_l", F.lit(True)), short_term.select(key).distinct().withColumn("_s", F.lit(True))
    keys = has_long.join(has_short, key, "full").join(n, key, "left").na.fill({"_n": 0})
    only_short = F.col("_l").isNull() | F.lit(s.click_prior == 0)
    only_long = ~only_short & (F.col("_s").isNull() | (F.col("_n") == 0))
    keys = keys.select(key, F.when(only_short, 0.0).when(only_long, 1.0).otherwise(s.click_prior).alias("_wl"), F.when(only_short, 1.0).when(only_long, 0.0).otherwise(F.col("_n").cast("double")).alias("_ws"))
    parts = long_term.join(keys, key).select(key, "term", (F.col("prob") * F.col("_wl")).alias("prob")).unionByName(short_term.join(keys, key).select(key, "term", (F.col("prob") * F.col("_ws")).alias("prob")))
    return truncated(normalised(parts.groupBy(key, "term").agg(F.sum("prob").alias("prob")).where("prob > 0"), key, "prob"), key, "prob", s.model_terms, s.model_min_prob)


@dataclass(frozen=True)
class Evidence:
    """What models of searches are made of, all by the key column: queries (key, text), results (key, doc, clicked), ratings (key, doc, rating),
    members of a search's session (key, other), likeness to past searches (key, other, cosine), models of past searches (other, term, prob),
    and, of the collection, doc_counts (doc, term, tf), probs and default."""

    queries: DataFrame
    results: DataFrame
    ratings: DataFrame
    members: DataFrame
    likeness: DataFrame
    past: DataFrame
    doc_counts: DataFrame
    probs: DataFrame
    default: DataFrame
    key: str = "search_id"
    other: str = "other_id"
    doc: str = "doc_id"
    settings: Settings = DEFAULTS

    def only(self, keys: DataFrame) -> Evidence:
        """The evidence of some searches (key); past searches and the collection stay."""
        of = lambda rows: rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return replace(self, **{n: of(getattr(self, n)) for n in ("queries", "results", "ratings", "members", "likeness")})


def _single(e: Evidence, **options) -> DataFrame:
    return mixture_model(weighted_counts(e.queries, e.results, e.doc_counts, e.key, e.doc, e.settings, **options), e.probs, e.default, e.key, e.settings)


def _pseudo(e: Evidence) -> DataFrame:
    return _single(e, clicked=0.0, pseudo=True)


def _with_history(e: Evidence, near: DataFrame) -> DataFrame:
    clicks = e.results.where("clicked").groupBy(e.key).agg(F.count(F.lit(1)).alias("n"))
    long = history_model(query_model(e.queries, e.key, s=e.settings), _pseudo(e), near, e.past, e.probs, e.default, e.key, e.other, e.settings)
    return combined_model(long, _single(e), clicks, e.key, e.settings)


def _session(e: Evidence) -> DataFrame:
    return _with_history(e, e.members.join(e.past.select(e.other).distinct(), e.other, "left_semi"))


def _long_term(e: Evidence) -> DataFrame:
    return _with_history(e, neighbours(e.likeness, e.members, e.past.select(F.col(e.other).alias(e.key)).distinct(), e.key, e.other, e.settings))


class ModelRegistry:
    """Models by name; each is built for a search once and kept until an event of a kind that it depends on is newer.

    What is kept are tables of a Store: the models (key, model, term, prob) and when each was built, searches without a term of a model too.
    """

    def __init__(self, store: Store, key: str = "search_id", kind: str = "long"):
        self.store, self.key = store, key
        self.schemas = {"models": f"{key} {kind}, model string, term string, prob double", "built": f"{key} {kind}, model string, ts timestamp_ntz"}
        self.builders: dict[str, tuple[Callable[[Evidence], DataFrame], tuple[str, ...]]] = {}

    def add(self, name: str, builder: Callable[[Evidence], DataFrame], *kinds: str) -> None:
        """A builder, and the kinds of events that outdate what it made."""
        self.builders[name] = (builder, kinds)

    def names(self) -> list[str]:
        """All models, in the order they were added."""
        return list(self.builders)

    def build(self, name: str, keys: DataFrame, evidence: Evidence, events: DataFrame, now: datetime) -> DataFrame:
        """key, term, prob of a model of the searches in keys (key); built are only those that are not kept or are outdated by events (key, type, ts)."""
        builder, kinds = self.builders[name]
        keys = keys.select(self.key).distinct()
        state = self.store.state()[1]
        built = self.store.table("built", self.schemas["built"], state).where(F.col("model") == name).groupBy(self.key).agg(F.max_by("ts", "_turn").alias("ts"))
        holds = any_outdated(built, events, self.key, *kinds).where("NOT outdated") if kinds else built
        needed = keys.join(holds, self.key, "left_anti")
        if needed.take(1):
            named = F.lit(name).alias("model")
            done = self.store.write("built", needed.select(self.key, named, F.lit(now).cast("timestamp_ntz").alias("ts")))
            needed = self.store.table("built", self.schemas["built"], {"parts": {"built": [[done, 0]]}})
            made = self.store.write("models", builder(evidence.only(needed)).select(self.key, named, "term", "prob"))

            def change(old: dict, turn: int) -> dict:
                old["parts"].setdefault("built", []).append([done, turn])
                old["parts"].setdefault("models", []).append([made, turn])
                return old

            self.store.commit(change)
            state = self.store.state()[1]
        last = self.store.table("built", self.schemas["built"], state).where(F.col("model") == name).groupBy(self.key).agg(F.max("_turn").alias("_last"))
        rows = self.store.table("models", self.schemas["models"], state).where(F.col("model") == name).join(last, self.key).where("_turn = _last")
        return rows.join(keys, self.key, "left_semi").select(self.key, "term", "prob")


def default_registry(store: Store, key: str = "search_id", kind: str = "long") -> ModelRegistry:
    r = ModelRegistry(store, key, kind)
    r.add("query", lambda e: query_model(e.queries, e.key, s=e.settings))
    r.add("pseudo", _pseudo, "view")
    r.add("explicit", lambda e: feedback_model(e.ratings, e.doc_counts, e.probs, e.default, e.key, e.doc, e.settings), "rating")
    r.add("single-search", _single, "click")
    r.add("session", _session, "click")
    r.add("long-term-history", _long_term, "click")
    return r


def outdated(models: DataFrame, events: DataFrame, key: str, kind: str) -> DataFrame:
    """models (key, ts) with outdated: whether an event of the kind is newer."""
    last = events.where(F.col("type") == kind).groupBy(key).agg(F.max("ts").alias("_last"))
    return models.join(last, key, "left").withColumn("outdated", F.coalesce(F.col("_last") > F.col("ts"), F.lit(False))).drop("_last")


def any_outdated(models: DataFrame, events: DataFrame, key: str, *kinds: str) -> DataFrame:
    """As outdated(), for a model made of several: whether an event of any of the kinds is newer. A model without kinds never is."""
    last = events.where(F.col("type").isin(*kinds)).groupBy(key).agg(F.max("ts").alias("_last"))
    return models.join(last, key, "left").withColumn("outdated", F.coalesce(F.col("_last") > F.col("ts"), F.lit(False))).drop("_last")


def kept_models(old: DataFrame, fresh: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Models (key, term, prob) by memory: the old one of a search whose state (key, outdated) says it still holds, else the fresh one."""
    good = state.where(~F.col("outdated")).select(key).join(old.select(key).distinct(), key, "left_semi")
    return old.join(good, key, "left_semi").unionByName(fresh.join(good, key, "left_anti"))
