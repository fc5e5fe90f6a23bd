"""Entity names: candidates for merging, groups, validation and application of merges, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import any_of, normalize_entity
from talkmill.plans.lineage import cut

# Shortest normal form compared, least ratio of lengths in tenths.
SHORTEST, LEAST_TENTHS = 3, 3
LONG = 256
SAMPLES = 3
# Reasons that contradict the merge they come with, matched without regard to case.
CONTRADICTIONS = (
    r"\bnot\b[^.]{0,40}\bmerge\b",
    r"\bwill not merge\b",
    r"\bwon'?t merge\b",
    r"\bdo not merge\b",
    r"\bshould(?: not|n'?t) be merged\b",
    r"\bdistinct\b[^.]{0,30}\bentit(?:y|ies)\b",
    r"\bare separate\b",
    r"\bkeep(?:ing)? (?:them |these )?separate\b",
    r"\bnot the same entity\b",
    r"\bdifferent\b[^.]{0,30}\bentit(?:y|ies)\b",
    r"\bavoid over-?merging\b",
    r"\btoo risky\b",
)


def names_of(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("entities").alias("entity")).where("entity IS NOT NULL").distinct()


def entity_pairs(names: DataFrame) -> DataFrame:
    """``a, b`` (a < b): names of which one is, in letters and digits, a prefix of the other and not much shorter.

    Each normal form is joined with its own prefixes, so names that merely begin
    alike never meet, however many do. Forms beyond ``LONG`` characters, whose
    prefixes would be too many, meet shorter ones on their first characters instead.
    """
    rows = names.select("entity", normalize_entity(F.col("entity")).alias("form")).where(F.length("form") >= SHORTEST)
    forms = rows.select("form").distinct()
    size = F.length("form")
    least = F.greatest(F.lit(SHORTEST), F.floor((size * LEAST_TENTHS + 9) / 10).cast("int"))
    lengths = F.explode(F.sequence(least, size))
    heads = forms.where(size <= LONG).select(F.col("form").alias("form_b"), lengths.alias("n")).select("form_b", F.expr("substring(form_b, 1, n)").alias("form_a"))
    near = heads.join(forms.withColumnRenamed("form", "form_a"), "form_a").select("form_a", "form_b")
    block = F.substring("form", 1, SHORTEST).alias("block")
    far = forms.select(F.col("form").alias("form_a"), block).join(forms.where(size > LONG).select(F.col("form").alias("form_b"), block), "block")
    far = far.where(F.col("form_b").startswith(F.col("form_a")) & (F.length("form_a") * 10 >= F.length("form_b") * LEAST_TENTHS))
    near = near.unionByName(far.select("form_a", "form_b"))
    a, b = rows.toDF("name_a", "form_a"), rows.toDF("name_b", "form_b")
    met = near.join(a, "form_a").join(b, "form_b").where("name_a <> name_b")
    return met.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct()


def group_by_label(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """``entity, group_key``: components of the pairs by spreading the smallest name, each round's state stored."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(rounds):
        heard = both.join(state.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = state.join(heard, "a").select("a", F.least("label", "heard").alias("next"), "label")
        # The label's own label is a label too: jumping halves the distance.
        far = step.select(F.col("a").alias("next"), F.col("next").alias("jump"))
        after = cut(step.join(far, "next", "left").select("a", F.least("next", "jump").alias("new"), "label"))
        changed = not after.where("new <> label").isEmpty()
        state = after.select("a", F.col("new").alias("label"))
        if not changed:
            return state.select(F.col("a").alias("entity"), F.col("label").alias("group_key"))
    raise RuntimeError("groups did not settle")


def entity_samples(facts: DataFrame, count: int = SAMPLES) -> DataFrame:
    """``entity, facts, samples``: number of active facts of each entity and its newest statements.

    Per entity only the newest few rows are kept while aggregating, so a frequent entity costs no more memory.
    """
    rows = facts.where("status = 'active'").select("id", "created_at", "statement", F.explode(F.array_distinct("entities")).alias("entity"))
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("created_at"), "id"))
    few = rows.withColumn("n", newest).where(F.col("n") <= count)
    samples = few.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "statement"))), lambda x: x["statement"]), " | ").alias("samples"))
    return rows.groupBy("entity").agg(F.count("*").alias("facts")).join(samples, "entity")


def contradicts(reason):
    return F.coalesce(any_of([reason.rlike(f"(?i){p}") for p in CONTRADICTIONS]), F.lit(False))


def valid_merges(merges: DataFrame, names: DataFrame) -> DataFrame:
    """``proposal_id, canonical, members``: merges of known names, at least two and with the canonical one, whose reason doesn't object.

    A name may be claimed once: a merge with a name that an earlier one of the
    same group claims is dropped. Claims are decided in order, greedily; merges
    without a common name don't affect each other, so the order is only kept
    within the groups they form.
    """
    known = names.select(F.col("entity").alias("member")).distinct()
    rows = merges.dropDuplicates(["proposal_id"]).where(F.col("canonical").isNotNull() & ~contradicts(F.coalesce("reason", F.lit(""))))
    flat = rows.select("proposal_id", "canonical", F.explode(F.array_distinct("members")).alias("member")).join(known, "member")
    whole = flat.groupBy("proposal_id", "canonical").agg(F.array_sort(F.collect_set("member")).alias("members"))
    fit = cut(whole.where((F.size("members") >= 2) & F.array_contains("members", F.col("canonical"))))
    # Greedy in rounds: a merge that is first for all its names is taken, all that share a name with one taken are out.
    open_, taken = fit, None
    while not open_.isEmpty():
        claims = open_.select("proposal_id", F.explode("members").alias("member"))
        first = claims.groupBy("member").agg(F.min("proposal_id").alias("first"))
        seen = claims.join(first, "member").groupBy("proposal_id").agg(F.bool_and(F.col("proposal_id") == F.col("first")).alias("wins"))
        won = cut(open_.join(seen.where("wins").select("proposal_id"), "proposal_id", "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode("members").alias("member")).distinct()
        out = claims.join(used, "member").select("proposal_id").distinct()
        open_ = cut(open_.join(out, "proposal_id", "left_anti"))
    return (taken if taken is not None else fit).select("proposal_id", "canonical", "members")


def aliases(merges: DataFrame) -> DataFrame:
    """``name, to``: one target per name, that of the first merge that names it; a canonical name keeps itself."""
    rows = merges.select("proposal_id", "canonical", F.explode("members").alias("name")).where("name IS NOT NULL AND name <> canonical")
    return rows.groupBy("name").agg(F.min_by("canonical", "proposal_id").alias("to"))


def apply_merges(facts: DataFrame, alias: DataFrame, now) -> DataFrame:
    """Facts with their entities renamed once (not transitively), sorted and distinct, where any of them has an alias."""
    flat = facts.select("id", F.explode("entities").alias("name")).join(alias, "name", "left")
    new = flat.groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("to", "name"))).alias("renamed"), F.bool_or(F.col("to").isNotNull()).alias("hit"))
    rows = facts.join(new.where("hit"), "id", "left")
    return rows.withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at"))).withColumn("entities", F.coalesce("renamed", "entities")).drop("renamed", "hit")


def cooccurrence(facts: DataFrame, least: int = 2) -> DataFrame:
    """``a, b, facts`` of entity pairs that active facts name together at least ``least`` times. Pairs are formed within one fact only."""
    names = F.array_sort(F.array_distinct("entities"))
    rows = facts.where("status = 'active'").select("id", F.explode(names).alias("a"), names.alias("all"))
    pairs = rows.select("id", "a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("facts")).where(F.col("facts") >= least)


def top_entities(facts: DataFrame, limit: int = 40) -> DataFrame:
    rows = facts.where("status = 'active'").select(F.explode("entities").alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("facts")).orderBy(F.desc("facts"), "entity").limit(limit)
