"""Mixing sources to target weights by hierarchical budgets.

Leaves of the tree are domain / language / source. Budgets go down from the root
by weight. A node that can't fill its budget (its tokens times ``epochs``) leaves a
shortage, which its siblings share by weight as far as they can; only what they
can't take goes up to the parent's siblings. A leaf's budget is filled by whole
documents in seeded order, epoch by epoch: all of the first epochs, then a prefix of
one more.

Budgets are whole tokens and are worked out in DataFrames, a level at a time. The
children of a node, ordered by supply per weight, are full up to a point; beyond it
all take the same share per weight. Running sums find that point, so shortages need
no rounds and leaves no cap.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import cut, unused

SEED = 17
EPOCHS = 3
SHARE = 0.5
LEVELS = ["domain", "lang", "source"]
#: Whole numbers of 0 at least. Missing names weigh DEFAULT_WEIGHT; a name of weight 0 takes what the others can't.
DOMAIN_WEIGHTS: Mapping[str, int] = {"d0": 3, "d1": 2, "d2": 2, "d3": 1}
LANG_WEIGHTS: Mapping[str, int] = {"en": 5, "fr": 2, "de": 2, "es": 1}
SOURCE_WEIGHTS: Mapping[str, int] = {}
DEFAULT_WEIGHT = 1
WEIGHTS = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
SLICES = 256
WORDS = r"[^\x20\x09-\x0D]+"


def weight_sql(name: str, weights: Mapping[str, int]) -> str:
    if any(w != int(w) or w < 0 for w in weights.values()):
        raise ValueError("weights are whole numbers of 0 at least")
    quoted = {n.replace("\\", "\\\\").replace("'", "\\'"): int(w) for n, w in weights.items()}
    return f"case {name} " + " ".join(f"when '{n}' then {w}" for n, w in quoted.items()) + f" else {DEFAULT_WEIGHT} end" if weights else str(DEFAULT_WEIGHT)


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given`` to children(*parent, name, supply, weight, budget), budget being their parent's.

    A child takes its weight's share of the budget, but never more than its supply;
    what some can't take, the others share. Children of weight 0 share alike what is
    left when all others are full. Tokens lost by rounding go one each to the first
    of those that aren't full, ordered by supply per weight, then by name, a null one
    last. The sum given is the smaller of budget and supply. Children of one node are
    ordered in one task: rows of names, not of documents, and the sort spills.
    """
    group = "partition by " + ", ".join([*parent, "weight > 0"] if parent else ["weight > 0"])
    whole = f"partition by {', '.join(parent)}" if parent else "partition by 1"
    order = f"{group} order by supply / w, {name} asc nulls last rows between unbounded preceding and 1 preceding"
    big = "decimal(38, 0)"
    x = children.selectExpr("*", f"sum(case when weight > 0 then supply else 0 end) over ({whole}) as firsts")
    # Those of weight 0 come second, with what the first leave, and weigh 1 each.
    x = x.selectExpr("*", "case when weight > 0 then weight else 1 end as w", "case when weight > 0 then budget else greatest(budget - firsts, 0) end as b")
    x = x.selectExpr("*", f"coalesce(sum(supply) over ({order}), 0) as s_before", f"sum(w) over ({group}) - coalesce(sum(w) over ({order}), 0) as w_left")
    x = x.selectExpr("*", f"cast(supply as {big}) * cast(w_left as {big}) <= cast(greatest(b - s_before, 0) as {big}) * cast(w as {big}) as full")
    # Beyond the full ones all have the same level: what is left of the budget over the weight that is left.
    x = x.selectExpr(
        "*", f"b - sum(case when full then supply else 0 end) over ({group}) as open_b", f"sum(case when full then 0 else w end) over ({group}) as open_w"
    )
    x = x.selectExpr("*", f"case when full then supply else cast(cast(open_b as {big}) * cast(w as {big}) div open_w as bigint) end as part")
    x = x.selectExpr(
        "*", f"open_b - sum(case when full then 0 else part end) over ({group}) as rest",
        f"row_number() over ({group}, full order by supply / w, {name} asc nulls last) as number",
    )
    return x.selectExpr(*children.columns, "case when not full and number <= rest then part + 1 else part end as given")


def budgets(leaves: DataFrame, share: float, weights: tuple[Mapping[str, int], ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """domain, lang, source, supply, budget of leaves(domain, lang, source, supply): ``share`` of all supplies (rounded down), shared out over supplies times ``epochs``."""
    leaves = cut(leaves)
    top = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * F.lit(share)).cast("long").alias("t")).first().t
    given = None
    for depth, name in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = leaves.groupBy(*parent, name).agg((F.sum("supply") * epochs).alias("supply")).withColumn("weight", F.expr(weight_sql(name, weights[depth])))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(top).cast("long"))
        else:
            up = given.select(*(F.col(c).alias(f"up_{c}") for c in parent), F.col("given").alias("budget"))
            on = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in parent]
            nodes = nodes.join(up, on).drop(*(f"up_{c}" for c in parent))
        given = shared_out(nodes, parent, name)
    return given.select(*LEVELS, F.expr(f"supply div {epochs}").alias("supply"), F.col("given").alias("budget"))


def with_tree(docs: DataFrame, domain: str | None = None) -> DataFrame:
    """doc_id, domain, lang, source, and tokens (words of the whole text; null: none).

    ``domain`` names the column that has a document's domain. Without one, a stand-in
    for tables that have none: the number in the source's name, modulo 4.
    """
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", r"([0-9]{1,9})", 1), F.lit("999999999")).cast("long"), F.lit(0))
    of = F.concat(F.lit("d"), (number % 4).cast("string")) if domain is None else F.col(domain).cast("string")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select("doc_id", of.alias("domain"), "lang", "source", tokens.alias("tokens"))


def place(epoch: int) -> str:
    """SQL of a document's place in an epoch's order: 15 hex digits."""
    return f"substr(md5(concat('{SEED}:{epoch}:', coalesce(cast(doc_id as string), ''))), 1, 15)"


def mix(
    docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, domain: str | None = None, weights: tuple[Mapping[str, int], ...] = WEIGHTS
) -> DataFrame:
    """One row for each chosen document: doc_id, domain, lang, source, tokens, copies (in how many epochs it is taken).

    The budget is ``share`` of all tokens. Rows of the same id and leaf, null ids too,
    count as one document of their summed tokens. Documents without tokens are never
    chosen. A leaf takes documents of an epoch in order while those before them
    leave any of its budget, so it exceeds its budget by less than one document.
    Null domains, languages and sources are leaves of their own. Documents at the same
    place of the order go by id. Extra columns are ignored; an empty table gives an
    empty result.

    A hot leaf is no single task: its documents fall in SLICES ranges of place,
    whose sums are small; only the range where the budget ends is put in order.
    """
    key = LEVELS
    sized = cut(with_tree(docs, domain).where("tokens > 0").groupBy("doc_id", *key).agg(F.sum("tokens").alias("tokens")))
    leaves = sized.groupBy(*key).agg(F.sum("tokens").alias("supply"))
    plan = cut(budgets(leaves, share, weights, epochs).select(
        *(F.col(c).alias(f"p_{c}") for c in key), F.expr("budget div supply").alias("whole"), (F.col("budget") % F.col("supply")).alias("rest")
    ))
    # A row for each leaf; Spark broadcasts it where its measured size allows that, and splits hot leaves elsewhere.
    told = sized.join(plan, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in key]).drop(*(f"p_{c}" for c in key))
    # The place in the last, partial epoch.
    last = " ".join(f"when {e} then {place(e)}" for e in range(epochs + 1))
    told = told.withColumn("place", F.expr(f"case whole {last} end")).withColumn(
        "slice", F.expr(f"cast(conv(substr(place, 1, {len(f'{SLICES - 1:x}')}), 16, 10) as int)")
    )
    sums = told.groupBy(*key, "slice").agg(F.sum("tokens").alias("t"))
    slices = sums.selectExpr(
        *(f"{c} as s_{c}" for c in key), "slice as s_slice",
        f"sum(t) over (partition by {', '.join(key)} order by slice) - t as before", "t as inside",
    )
    on = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in key] + [F.col("slice") == F.col("s_slice")]
    placed = told.join(slices, on)
    clear = placed.where("before + inside <= rest or before >= rest").withColumn("extra", F.expr("int(before < rest)"))
    edge = placed.where("before + inside > rest and before < rest").withColumn(
        "extra",
        F.expr(
            "int(before + sum(tokens) over (partition by domain, lang, source, slice order by place, doc_id) - tokens < rest)"
        ),
    )
    chosen = clear.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("extra")).cast("long"))
    return chosen.where("copies > 0").select("doc_id", *key, "tokens", "copies")


def mix_documents(
    docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, domain: str | None = None, weights: tuple[Mapping[str, int], ...] = WEIGHTS
) -> DataFrame:
    """``docs`` as chosen by ``mix``: each row with words as often as its document has copies; rows of one id in two leaves go each by its own."""
    own = LEVELS[1:] if domain is None else LEVELS
    column = {"domain": domain, "lang": "lang", "source": "source"}
    names = {c: unused(docs.columns, f"chosen_{c}") for c in ("doc_id", *own, "copies", "copy")}
    chosen = mix(docs, share, epochs, domain, weights).select(*(F.col(c).alias(names[c]) for c in ("doc_id", *own, "copies")))
    on = [F.col("doc_id").eqNullSafe(F.col(names["doc_id"])), *(F.col(column[c]).cast("string").eqNullSafe(F.col(names[c])) for c in own)]
    repeated = docs.where(F.col("text").rlike(WORDS)).join(chosen, on)
    return repeated.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).select(docs.columns)
