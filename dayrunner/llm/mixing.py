"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source, language and topic. The cells are
raked: scaled to the target share of each source, then of each language, then of
each topic, over and over. A document of a cell is then sampled with the
probability in proportion to (raked tokens) / (tokens there are), at most one,
calibrated so that the expected sample is ``portion`` of all tokens. Whether a
document is taken depends on its id alone, so a run can be repeated.

The topic here is the style of writing, told from character classes: no topic
column is given. Targets flatten the corpus: each share to the power
``flatten``, rescaled.

Cells are few against documents but not bounded; they stay a table throughout.
Defined cases: null text has no tokens; a document without tokens is kept with
its cell's probability. Null source, language and topic are values of their own.
A null id is taken by the same rule as an empty one. Rows that repeat an id are
taken or left together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrunner.llm.common import prepared, share, spare
from dayrunner.session import checkpointed, written

ROUNDS = 12
ROUNDS_A_CUT = 4
FLATTEN = 0.7
PORTION = 0.5
CALIBRATIONS = 8
SEED = "mix"
MARGINS = ("source", "lang", "topic")
WORD = "[^\\x20\\x09-\\x0D]+"


def style(text: Column) -> Column:
    """Topic of a text by ASCII character classes: empty, symbols, capitals, figures or prose."""
    def count(letters: str) -> Column:
        # Whole runs of other characters go at once; one match a character costs time and garbage.
        return F.length(F.regexp_replace(text, f"[^{letters}]++", ""))

    n = F.length(text)
    return (
        F.when(n == 0, "empty")
        .when(count("*#$%&|!") * 25 > n, "symbols")
        .when(count("A-Z") * 4 > n, "capitals")
        .when(count("0-9") * 20 > n, "figures")
        .otherwise("prose")
    )


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words between ASCII white space)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in (
        ("source", docs[source_col]), ("lang", docs[lang_col]), ("topic", style(text) if topic is None else topic))]
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), *named, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))


def flattened(cells: DataFrame, power: float = FLATTEN) -> dict[str, DataFrame]:
    """Target share of every value of each margin: margin -> (value, target)."""
    out = {}
    for margin in MARGINS:
        held = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raised"))
        total = held.agg(F.sum("raised")).first()[0] or 1.0
        out[margin] = held.select(margin, (F.col("raised") / F.lit(total)).alias("target"))
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``weight``, the raked share of all tokens.

    Values without a target and cells without tokens have weight zero. A margin
    that can't be met for want of cells is met as far as the last scaling goes.
    """
    for margin, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"{margin}_target"), margin, "left")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumns({f"{m}_target": F.coalesce(f"{m}_target", F.lit(0.0)) for m in targets})
    now = now.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    now = checkpointed(now)
    for k in range(rounds):
        for margin in targets:
            held = F.sum("weight").over(Window.partitionBy(margin))
            now = now.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"{margin}_target") / held).otherwise(0.0))
        if (k + 1) % ROUNDS_A_CUT == 0:
            now = checkpointed(now)
    return now.drop(*[f"{m}_target" for m in targets])


def probabilities(cells: DataFrame, portion: float = PORTION) -> DataFrame:
    """The raked cells with ``probability``, so that ``portion`` of the tokens are expected.

    Cells whose probability would pass one are taken whole, and the rest is
    scaled up for them, until no more cells pass. A cell without tokens has
    probability one: it doesn't change the mix.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    scale = 0.0
    for _ in range(CALIBRATIONS):
        whole = rate * F.lit(scale) >= 1
        held = cells.agg(
            F.sum("tokens").alias("all"), F.sum(F.when(whole, F.col("tokens"))).alias("taken"),
            F.sum(F.when(~whole, F.col("weight"))).alias("open")).first()
        if not held["open"]:
            break
        scale = (portion * held["all"] - (held["taken"] or 0)) / held["open"]
    return cells.withColumn(
        "probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * F.lit(scale))).otherwise(1.0))


def fitted(rows: DataFrame, targets: dict[str, DataFrame] | None, rounds: int, portion: float) -> DataFrame:
    """source, lang, topic and probability of every cell of the described rows."""
    cells = written(cells_of(rows))
    return probabilities(raked(cells, targets or flattened(cells), rounds), portion).select(*MARGINS, "probability")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rounds: int = ROUNDS,
    portion: float = PORTION, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept."""
    prepared(docs.sparkSession)
    rows = written(described(docs, id_col, text_col, source_col, lang_col, topic))
    return rows.join(fitted(rows, targets, rounds, portion), list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "probability", (share(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def keep_sampled(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rounds: int = ROUNDS,
    portion: float = PORTION, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The sampled documents with all their columns; their texts meet the cells where they are read."""
    prepared(docs.sparkSession)
    rows = described(docs, id_col, text_col, source_col, lang_col, topic)
    names = {m: spare(docs, f"_{m}") for m in (*MARGINS, "probability")}
    cells = fitted(rows, targets, rounds, portion).withColumnsRenamed(names)
    text = F.coalesce(docs[text_col], F.lit(""))
    values = {"source": docs[source_col], "lang": docs[lang_col], "topic": style(text) if topic is None else topic}
    marked = docs.withColumns({names[m]: F.coalesce(v.cast("string"), F.lit("")) for m, v in values.items()})
    chosen = marked.join(cells, [names[m] for m in MARGINS])
    return chosen.filter(share(F.col(id_col).cast("long"), seed) < F.col(names["probability"])).select(*docs.columns)


def oracle(rounds: int = ROUNDS, power: float = FLATTEN, portion: float = PORTION, seed: str = SEED) -> str:
    """DuckDB SQL for ``mix`` over documents; every scaling is a CTE."""
    def count(letters: str) -> str:
        return f"length(regexp_replace(t, '[^{letters}]', '', 'g'))"

    parts = [f"""d as (
        select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, t,
            case when length(t) = 0 then 'empty' when {count("*#$%&|!")} * 25 > length(t) then 'symbols'
                when {count("A-Z")} * 4 > length(t) then 'capitals' when {count("0-9")} * 20 > length(t) then 'figures'
                else 'prose' end as topic,
            len(regexp_extract_all(t, '{WORD}')) as n_tokens
        from (select doc_id, source, lang, coalesce(text, '') as t from documents))""",
        "cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)"]
    for m in MARGINS:
        parts.append(f"t_{m} as materialized (select {m}, x / sum(x) over () as target from (select {m}, pow(sum(tokens), {power}) as x from cells group by 1))")
    parts.append("w0 as materialized (select *, tokens / sum(tokens) over () as weight from cells)")
    last = "w0"
    for k in range(rounds):
        for m in MARGINS:
            name = f"w{k + 1}_{m}"
            parts.append(f"{name} as materialized (select source, lang, topic, tokens, weight * target / sum(weight) over (partition by {m}) as weight "
                         f"from {last} join t_{m} using ({m}))")
            last = name
    rate = "(case when tokens > 0 then weight / tokens else 0 end)"
    parts.append("c0 as materialized (select 0.0::double as scale)")
    for k in range(CALIBRATIONS):
        whole = f"{rate} * scale >= 1"
        parts.append(
            f"c{k + 1} as materialized (select coalesce(({portion}::double * sum(tokens) - coalesce(sum(case when {whole} then tokens end), 0)) "
            f"/ nullif(sum(case when not ({whole}) then weight end), 0), any_value(scale)) as scale from {last}, c{k})")
    parts.append(f"p as (select source, lang, topic, case when tokens > 0 then least(1.0, {rate} * scale) else 1.0 end as probability "
                 f"from {last}, c{CALIBRATIONS})")
    return f"""with {", ".join(parts)}
        select doc_id, source, lang, topic, n_tokens, round(probability, 6) as probability,
            ('0x' || substr(md5(doc_id::varchar || '/{seed}'), 1, 13))::bigint / pow(16, 13) < probability as kept
        from d join p using (source, lang, topic)"""
