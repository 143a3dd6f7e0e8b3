"""Entity resolution: match strategies, merge, prune, comparison of records and tables."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import barrier
from ..functions.text import canonical_id, common_letters, extract_model, letter_counts, normal_model, slug, token_sort
from ..schema import is_filled
from ..scratch import written
from .windows import first_wins

STRATEGIES = ("exact_model", "alias", "regex", "wikidata_qid", "fuzzy", "name")
FUZZY_LEAST = 85.0


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


#: Letters that the pieces of a name have at least; shorter ones tell too little.
LEAST_PIECE = 3


def _pieces(n: int, e: int, least: float) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(n_len, e_len, most, piece, start, size, low, high) for names of n and e letters: the pieces of the second, of which one at least stands unbroken in the first, ``low`` to ``high`` letters further on.

    ``most`` letters at most are put in or left out where the score is reached, and each of
    them breaks one piece; so one piece more than that will do. One empty piece, which all have, where pieces would be too short; none if the lengths rule the score out.
    """
    common = ceil(least * (n + e) / 200.0 - 1e-9)
    if common > min(n, e):
        return []
    most = n + e - 2 * common
    if e // (most + 1) < LEAST_PIECE:
        return [(n, e, most, 0, 0, 0, 0, 0)]
    cuts = [e * k // (most + 1) for k in range(most + 2)]
    return [(n, e, most, k, a, b - a, common - e, n - common) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def fuzzy_candidates(new: DataFrame, old: DataFrame, least: float = FUZZY_LEAST, scoped: bool = False) -> DataFrame:
    """(n_id, e_id, score) of names alike within a vendor, and within n_scope and e_scope if ``scoped``.

    Blocked by vendor, lengths and an unbroken piece of the name (``_pieces``), so no pair that reaches the score is
    lost. Pairs whose edit distance or letter counts rule it out are dropped before the score is taken, and equal names are compared once.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.where((F.col(p + "name") != "") & (F.col(p + "vendor") != "")).select(F.lower(p + "vendor").alias("v"), p + "name").distinct()
        named = named.withColumn(p + "s", token_sort(F.col(p + "name"))).where(F.length(p + "s") > 0)
        return named.withColumn(p + "len", F.length(p + "s"))

    a, b = side(new, "n_"), side(old, "e_")
    a = written(a.join(b.select("v").distinct(), "v", "left_semi"))
    lengths = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  as many as the longest name has letters
    e_lengths = lengths(b, "e_len")
    rows = [row for n in lengths(a, "n_len") for e in e_lengths for row in _pieces(n, e, least)]
    plan = F.broadcast(a.sparkSession.createDataFrame(rows, "n_len int, e_len int, most int, piece int, start int, size int, low int, high int"))
    key = lambda text: F.xxhash64("v", "n_len", "e_len", "piece", text)
    places = F.sequence(F.greatest(F.lit(0), F.col("start") + F.col("low")), F.least(F.col("n_len") - F.col("size"), F.col("start") + F.col("high")))
    found = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("n_s"), i + 1, F.col("size"))))
    asked = a.join(plan, "n_len").select("v", "n_name", "n_s", "n_len", "e_len", "piece", "most", F.explode(found).alias("text"))
    asked = asked.select(key(F.col("text")).alias("key"), "v", "n_name", "n_s", "most")
    kept = b.join(plan, "e_len").select(key(F.substring(F.col("e_s"), F.col("start") + 1, F.col("size"))).alias("key"), F.col("v").alias("e_v"), "e_name", "e_s")
    length = F.length("n_s") + F.length("e_s")
    common = F.aggregate(F.zip_with(letter_counts(F.col("n_s")), letter_counts(F.col("e_s")), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    met = asked.join(kept, "key").where((F.col("v") == F.col("e_v")) & (F.call_function("levenshtein", F.col("n_s"), F.col("e_s"), F.col("most")) >= 0))
    # Written, as a filter would go before the distinct and be taken for every piece that a pair has in common.
    met = written(met.select("v", "n_name", "n_s", "e_name", "e_s").distinct()).where(F.lit(200.0) * common / length >= least)
    scored = barrier(met.withColumn("score", F.lit(200.0) * common_letters(F.col("n_s"), F.col("e_s")) / length))
    pairs = scored.where(F.col("score") >= least).select("v", "n_name", "e_name", "score")
    out = new.withColumn("v", F.lower("n_vendor")).join(pairs, ["v", "n_name"]).join(old.withColumn("v", F.lower("e_vendor")), ["v", "e_name"])
    return (out.where("n_scope = e_scope") if scoped else out).select("n_id", "e_id", "score")


def _known_aliases(e: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scope, alias, e_id) of existing rows that an alias names: their name holds it or is in it, or their model is the alias.

    Names' pieces of the aliases' lengths meet the aliases, aliases' pieces of the names' lengths meet the names: joins by equality, whatever the number of either.
    """
    alias = aliases.select(F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    named = e.where(F.coalesce("e_name", F.lit("")) != "").select("e_scope", F.lower("e_name").alias("low"), "e_id").groupBy("e_scope", "low").agg(F.min("e_id").alias("e_id"))
    lengths = [r.n for r in alias.select(F.length("alias").alias("n")).distinct().collect()]  # as many as the longest alias has letters
    piece = lambda text, n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = named.select("e_scope", "e_id", F.explode(F.array_distinct(F.flatten(F.array(*[piece(F.col("low"), n) for n in lengths])))).alias("alias")).join(alias, "alias") if lengths else named.select("e_scope", "e_id", F.col("low").alias("alias")).limit(0)
    sizes = [r.n for r in named.select(F.length("low").alias("n")).distinct().collect()]  # as many as the longest name has letters
    spans = F.flatten(F.array(*[piece(F.col("alias"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    within = alias.select("alias", F.explode(F.array_distinct(spans)).alias("low")).join(named, "low")
    models = e.select("e_scope", "e_id", F.lower("e_model").alias("alias")).join(alias, "alias")
    cols = ["e_scope", "alias", "e_id"]
    return held.select(*cols).unionByName(within.select(*cols)).unionByName(models.select(*cols)).groupBy("e_scope", "alias").agg(F.min("e_id").alias("e_id"))


def match(new: DataFrame, existing: DataFrame, aliases: DataFrame | None = None, pos: str = "_pos", within: str | None = None, by_id: bool = False) -> DataFrame:
    """(id, match_id, strategy) of every new row by the first strategy that finds an existing one; else no_match.

    Rows have id, name, vendor, model and, where known, wikidata_id; aliases
    are rows of (model, alias). Exact models go by the existing rows' place,
    the others by id. ``within`` names a column that both must share; with ``by_id`` an equal id comes before all strategies.

    Both sides become rows of (strategy, key) and meet in one join; only what
    that leaves, or finds by name alone, is compared by likeness.
    """
    for c in ("name", "vendor", "model", "wikidata_id"):
        new = new if c in new.columns else new.withColumn(c, F.lit(None).cast("string"))
        existing = existing if c in existing.columns else existing.withColumn(c, F.lit(None).cast("string"))
    if pos not in existing.columns:
        existing = existing.withColumn(pos, F.col("id"))
    scope = F.lit("") if within is None else F.coalesce(F.lower(F.col(within).cast("string")), F.lit(""))
    n, e = _side(new.select("id", "name", "vendor", "model", "wikidata_id", scope.alias("scope")), "n_"), _side(existing.select("id", "name", "vendor", "model", "wikidata_id", pos, scope.alias("scope")), "e_")
    model = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    rank = STRATEGIES.index

    def keyed(df: DataFrame, keys: dict[int, Column], kept: list[str], *more) -> DataFrame:
        """A row for each strategy for which a row has a key."""
        both = F.filter(F.array(*[F.struct(F.lit(k).alias("prio"), key.alias("key")) for k, key in keys.items()]), lambda x: x["key"].isNotNull())
        return df.select(*more, F.explode(both).alias("_k")).select(*kept, "_k.*")

    own = {rank("exact_model"): model(F.col("e_model")), rank("regex"): model(F.col("e_model")), rank("wikidata_qid"): some(F.col("e_wikidata_id")), rank("name"): some(F.lower("e_name"))}
    sought = {rank("exact_model"): model(F.col("n_model")), rank("regex"): extract_model(F.concat_ws(" ", "n_name", "n_model")), rank("wikidata_qid"): some(F.col("n_wikidata_id")), rank("name"): some(F.lower("n_name"))}
    if by_id:
        own[-1], sought[-1] = F.col("e_id").cast("string"), F.col("n_id").cast("string")
    first = F.when(F.col("prio") == rank("exact_model"), F.min_by("e_id", F.struct(f"e_{pos}", "e_id"))).otherwise(F.min("e_id"))
    targets = keyed(e, own, ["e_scope", "e_id", f"e_{pos}"], "e_scope", "e_id", f"e_{pos}").groupBy(F.col("e_scope").alias("scope"), "prio", "key").agg(first.alias("e_id"))
    asked = keyed(n, sought, ["scope", "n_id"], F.col("n_scope").alias("scope"), "n_id")
    if aliases is not None:
        known = _known_aliases(e, aliases).select(F.col("e_scope").alias("scope"), F.lit(rank("alias")).alias("prio"), F.col("alias").alias("key"), "e_id")
        targets = targets.unionByName(known)
        of_model = aliases.select(normal_model(F.col("model")).alias("m"), F.lower("alias").alias("key"))
        asked = asked.unionByName(n.withColumn("m", normal_model(F.col("n_model"))).join(of_model, "m").select(F.col("n_scope").alias("scope"), "n_id", F.lit(rank("alias")).alias("prio"), "key"))
    met = asked.join(targets, ["scope", "prio", "key"]).groupBy("n_id").agg(F.min(F.struct("prio", "e_id")).alias("best"))
    found = written(met.select("n_id", "best.*"))
    # Likeness comes before equal names, so rows found by name alone are compared too.
    left = n.join(found.where(F.col("prio") < rank("fuzzy")).select("n_id"), "n_id", "left_anti")
    alike = fuzzy_candidates(left, e, scoped=within is not None)
    alike = first_wins(alike, ["n_id"], [F.col("score").desc(), "e_id"]).select("n_id", F.lit(rank("fuzzy")).alias("prio"), "e_id")
    best = found.unionByName(alike).groupBy("n_id").agg(F.min(F.struct("prio", "e_id")).alias("best")).select("n_id", "best.*")
    name = F.when(F.col("prio") < 0, "id").otherwise(F.get(F.array(*[F.lit(s) for s in STRATEGIES]), F.greatest("prio", F.lit(0))))
    return new.select("id").join(best, F.col("id") == F.col("n_id"), "left").select("id", F.col("e_id").alias("match_id"), F.when(F.col("e_id").isNull(), "no_match").otherwise(name).alias("strategy"))


def deduplicate(new: DataFrame, existing: DataFrame, only_new: bool = False, **kw) -> DataFrame:
    """New rows with ``_dedup_strategy``; those without a match only, if wanted."""
    out = new.join(match(new, existing, **kw).select("id", F.col("strategy").alias("_dedup_strategy")), "id")
    return out.where(F.col("_dedup_strategy") == "no_match") if only_new else out


def coalesce_fields(df: DataFrame, first: str, second: str, fields: list[str]) -> list[Column]:
    """Of each field the first side's value where it has content, else the second's."""
    return [F.when(is_filled(df, first + f), F.col(first + f)).otherwise(F.col(second + f)).alias(f) for f in fields]


def merge_records(a: DataFrame, b: DataFrame, key: str = "id", b_wins: bool = True) -> DataFrame:
    """Full outer merge field by field; b's content wins, or only fills what a lacks."""
    fields = [c for c in a.columns if c != key]
    both = _side(a, "a_").join(_side(b.select(*[c for c in a.columns if c in b.columns]), "b_"), F.col(f"a_{key}") == F.col(f"b_{key}"), "full")
    for f in fields:
        if f"b_{f}" not in both.columns:
            both = both.withColumn(f"b_{f}", F.lit(None).cast(a.schema[f].dataType))
    first, second = ("b_", "a_") if b_wins else ("a_", "b_")
    return both.select(F.coalesce(f"a_{key}", f"b_{key}").alias(key), *coalesce_fields(both, first, second, fields))


def upsert(existing: DataFrame, new: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Existing rows with the content that matched new rows add, then new rows without a match.

    A match takes the new name and model and fills empty fields; the batch is
    first made one row for each canonical id, so its order doesn't count.
    """
    new = first_wins(new.withColumn("_key", canonical_id(F.col("vendor"), F.col("model"), F.col("name"))), ["_key"], ["id"]).drop("_key")
    found = match(new, existing, aliases)
    hit = first_wins(new.join(found.where("match_id is not null"), "id"), ["match_id"], ["id"])
    own = [c for c in existing.columns]
    n = _side(hit.select("match_id", *[c for c in own if c in hit.columns]), "n_")
    both = existing.join(n, existing["id"] == n["n_match_id"], "left")
    cols = []
    for c in own:
        if c == "id" or f"n_{c}" not in both.columns:
            cols.append(F.col(c))
        elif c in ("name", "model"):
            cols.append(F.when(is_filled(both, f"n_{c}"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(is_filled(both, c), F.col(c)).otherwise(F.coalesce(f"n_{c}", c)).alias(c))
    added = new.join(found.where("match_id is null").select("id"), "id")
    return both.select(*cols).unionByName(added.select(*[c for c in own if c in added.columns]), allowMissingColumns=True)


def folded(df: DataFrame, key: str, pos: str, last: tuple[str, ...] = ("name", "model")) -> DataFrame:
    """One row for each key: of each field the first content by place, of the fields in ``last`` the last one."""
    at = {c: F.when(is_filled(df, c), F.col(pos)) for c in df.columns if c != key}
    return df.groupBy(key).agg(*[(F.max_by if c in last else F.min_by)(c, place).alias(c) for c, place in at.items()])


def merge_into(existing: DataFrame, new: DataFrame, aliases: DataFrame | None = None, pos: str = "_pos", within: str | None = "vendor", by_id: bool = False) -> DataFrame:
    """The existing rows' columns and ``_merge``: kept, updated, renamed or added.

    New rows with one canonical id are one record, and so are those that match one existing row:
    the last name and model by place, of other fields the first content. A
    match takes the record's name and model and fills empty fields. If the
    slug of its name and model is then another id than its own, and no existing or
    added row has that id, it is renamed, with the identifier (uuid) that
    belongs to it; of several rows that want an id the one with the smallest own id gets
    it. A record without a match is added, in place of an unmatched row of
    its id. Rows only match within one value of ``within``.
    """
    own = existing.columns
    if "uuid" in own:
        existing = existing.withColumn("uuid", F.coalesce("uuid", canonical_id(F.col("vendor"), F.col("model"), F.col("name"))))
    if pos not in new.columns:
        new = new.withColumn(pos, F.col("id"))
    key = canonical_id(F.coalesce("vendor", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("name", F.lit("")))
    scope = [F.coalesce(F.col(within).cast("string"), F.lit(""))] if within else []
    batch = written(folded(new.withColumn("_key", F.concat_ws("/", *scope, key)), "_key", pos))
    found = written(batch.join(match(batch, existing, aliases, within=within, by_id=by_id), "id"))
    hit = folded(found.where("match_id is not null").drop("id", "strategy", "_key"), "match_id", pos)
    added = first_wins(found.where("match_id is null"), ["id"], [F.col(pos).desc()])
    n = _side(hit.select("match_id", *[c for c in own if c in hit.columns]), "n_")
    both = existing.join(n, F.col("id") == F.col("n_match_id"), "left")
    cols = []
    for c in own:
        if f"n_{c}" not in both.columns:
            cols.append(F.col(c))
        elif c in ("name", "model"):
            cols.append(F.when(is_filled(both, f"n_{c}"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(is_filled(both, c), F.col(c)).otherwise(F.coalesce(f"n_{c}", c)).alias(c))
    changed = written(both.select(*cols, F.when(F.col("n_match_id").isNull(), "kept").otherwise("updated").alias("_merge")))
    want = changed.where("_merge = 'updated'").select("id", slug(F.coalesce("name", F.lit("")), F.col("model")).alias("_want")).where("_want <> id")
    taken = existing.select("id").unionByName(added.select("id")).select(F.col("id").alias("_want"))
    granted = first_wins(want.join(taken, "_want", "left_anti"), ["_want"], ["id"])
    out = changed.join(granted, "id", "left")
    renamed = F.col("_want").isNotNull()
    again = canonical_id(F.coalesce("vendor", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("name", F.lit("")))
    values = {"id": F.when(renamed, F.col("_want")).otherwise(F.col("id")), "uuid": F.when(renamed, again).otherwise(F.col("uuid")) if "uuid" in own else None}
    out = out.select(*[values[c].alias(c) if c in values else F.col(c) for c in own], F.when(renamed, "renamed").otherwise(F.col("_merge")).alias("_merge"))
    out = out.join(added.select("id").withColumn("_over", F.lit(True)), "id", "left").where("_over is null or _merge <> 'kept'").drop("_over")
    if "uuid" in own and "uuid" not in added.columns:
        added = added.withColumn("uuid", F.lit(None).cast("string"))
    if "uuid" in own:
        added = added.withColumn("uuid", F.coalesce("uuid", again))
    return out.unionByName(added.select(*[c for c in own if c in added.columns], F.lit("added").alias("_merge")), allowMissingColumns=True).select(*own, "_merge")


def prune(existing: DataFrame, matched: DataFrame, least: float = 0.28, prefixes: tuple[str, ...] = ("mali", "adreno", "powervr")) -> DataFrame:
    """Rows that stay: matched ones (by id), and others unless they are poor, or stale twins of a matched one.

    Poor: a completeness below ``least`` or a name of a part only. Stale: the
    same model as a matched row, and names that contain each other or share a
    word of more than two letters.
    """
    kept = existing.join(matched.select("id"), "id", "left_semi")
    rest = existing.join(matched.select("id"), "id", "left_anti")
    low = F.lower(F.coalesce("name", F.lit("")))
    poor = (F.coalesce("completeness", F.lit(0.0)) < least) | reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes])
    rest = rest.where(~poor)
    m = F.nullif(F.upper(F.trim("model")), F.lit(""))
    twins = kept.select(m.alias("_m"), F.lower("name").alias("_name")).where("_m is not null").distinct()
    words = F.filter(F.split(F.col("_name"), r"\s+"), lambda w: F.length(w) > 2)
    alike = low.contains(F.col("_name")) | F.col("_name").contains(low) | F.exists(words, lambda w: low.contains(w))
    stale = rest.withColumn("_m", m).join(twins, "_m").where(alike).select("id").distinct()
    return kept.unionByName(rest.join(stale, "id", "left_anti"))


def compare(df: DataFrame, a, b, id_col: str = "id", skip: tuple[str, ...] = ()) -> DataFrame:
    """(field, value_a, value_b, same) of two records; both missing is the same."""
    fields = [c for c in df.columns if c != id_col and c not in skip]
    as_text = [F.to_json(F.col(c)).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string").alias(c) for c in fields]
    two = df.where(F.col(id_col).isin(a, b)).select(F.col(id_col), *as_text).unpivot([id_col], fields, "field", "value")
    out = two.groupBy("field").agg(F.max(F.when(F.col(id_col) == a, F.col("value"))).alias("value_a"), F.max(F.when(F.col(id_col) == b, F.col("value"))).alias("value_b"))
    return out.withColumn("same", F.col("value_a").eqNullSafe(F.col("value_b")))


def compare_tables(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(kind, field, n): fields that differ by key, and keys that only one table has."""
    fields = [c for c in a.columns if c in b.columns and c != key]
    both = _side(a, "a_").join(_side(b, "b_"), F.col(f"a_{key}") == F.col(f"b_{key}"), "full")
    sums = [F.sum((F.col(f"a_{key}").isNotNull() & F.col(f"b_{key}").isNotNull() & ~F.to_json(F.struct(f"a_{c}")).substr(len(c) + 5, 1 << 20).eqNullSafe(F.to_json(F.struct(f"b_{c}")).substr(len(c) + 5, 1 << 20))).cast("long")).alias(f"mismatch:{c}") for c in fields]
    only = [F.sum(F.col(f"b_{key}").isNull().cast("long")).alias("missing:"), F.sum(F.col(f"a_{key}").isNull().cast("long")).alias("extra:")]
    wide = both.agg(*sums, *only)
    out = wide.unpivot([], wide.columns, "what", "n")
    return out.select(F.split("what", ":")[0].alias("kind"), F.split("what", ":")[1].alias("field"), F.coalesce("n", F.lit(0)).alias("n"))


def merge_layers(base: DataFrame, live: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(vendor, kind, key, value) of the facts that stand, the live ones and corrections.

    Live facts fill gaps in maps, but a live architecture replaces the one that
    stands; corrections win over both. Null and empty values are no facts.
    """
    layers = [base, live, *([overrides] if overrides is not None else [])]
    tagged = reduce(DataFrame.unionByName, [d.select("vendor", "kind", "key", "value", F.lit(k).alias("_layer")) for k, d in enumerate(layers)])
    tagged = tagged.where(F.coalesce(F.col("value"), F.lit("")) != "")
    weight = F.when(F.col("_layer") == 2, 3).when(F.col("kind") == "architecture", F.col("_layer")).otherwise(1 - F.col("_layer"))
    # An architecture has no key.
    key = F.when(F.col("kind") == "architecture", F.lit("")).otherwise(F.col("key")).alias("key")
    return tagged.select("vendor", "kind", key, "value", weight.alias("_weight")).groupBy("vendor", "kind", "key").agg(F.max_by("value", F.struct("_weight", "value")).alias("value"))
