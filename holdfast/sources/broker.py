"""Broker holdings files: tolerant ingest, validated landing, source choice and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.grouping import top_per_group
from holdfast.sources.files import list_files

# Accepted headers per field, in order of preference.
ALIASES = {
    "ticker": ("ticker", "symbol", "código", "codigo", "ativo", "stock"),
    "name": ("name", "nome", "description", "descrição", "descricao", "company"),
    "shares": (
        "shares", "quantity", "total_quantity", "available_quantity", "quantidade", "qtd", "qty", "cotas",
    ),
    "cost": (
        "cost_basis", "cost_basis_per_share", "avg_price", "preco_medio", "preço_médio",
        "average_price", "custo_medio",
    ),
    "price": ("current_price", "price", "last_price", "preco", "preço", "cotacao", "cotação"),
}
MAX_TICKER = 10
# Which kind of source wins, first listed first.
SOURCE_ORDER = ("preferred", "inbox", "private", "fixture")


def find_column(columns: list[str], field: str) -> str | None:
    """The header matching a field's first listed alias (case, spaces and edges ignored)."""
    normalized = {c.lower().strip().replace(" ", "_"): c for c in columns}
    return next((normalized[a] for a in ALIASES[field] if a in normalized), None)


def normalize_rows(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All-text broker rows to positions; ``reject`` says why a row cannot be used.

    Rejected: shares that are no number above zero, a cost or price that is no number or below zero, a ticker
    of over ten characters. Blank tickers are dropped. A missing price falls back to the cost, a missing cost to zero.
    """
    found = {field: find_column(raw.columns, field) for field in ALIASES}
    for field in ("ticker", "shares"):
        if found[field] is None:
            raise ValueError(f"no {field} column; expected one of {ALIASES[field]}, found {raw.columns}")

    def number(field: str, scale: str) -> str:
        if found[field] is None:
            return f"cast(NULL AS {scale})"
        text = f"nullif(btrim(replace(replace(`{found[field]}`, ',', ''), '$', '')), '')"
        return f"try_cast({text} AS {scale})"

    ticker = f"upper(btrim(`{found['ticker']}`))"
    name = f"coalesce(btrim(`{found['name']}`), {ticker})" if found["name"] else ticker
    shares = f"try_cast(replace(`{found['shares']}`, ',', '') AS decimal(20,8))"
    bad = " OR ".join(
        [f"{shares} IS NULL"]
        + [f"{shares} <= 0", f"length({ticker}) > {MAX_TICKER}"]
        + [f"{number(f, 'decimal(18,4)')} < 0" for f in ("cost", "price") if found[f]]
        + [
            f"(nullif(btrim(`{found[f]}`), '') IS NOT NULL AND {number(f, 'decimal(18,4)')} IS NULL)"
            for f in ("cost", "price") if found[f]
        ]
    )
    cost = f"coalesce({number('cost', 'decimal(18,4)')}, cast(0 AS decimal(18,4)))"
    return raw.filter(f"{ticker} <> ''").selectExpr(
        *keep, f"{ticker} AS ticker", f"{name} AS name", f"{shares} AS shares", f"{cost} AS cost",
        f"coalesce({number('price', 'decimal(18,4)')}, {cost}) AS price",
        f"if(coalesce({bad}, false), 'invalid value', NULL) AS reject",
    )


def read_broker_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positions of every CSV under ``path`` (one header layout), with their source file and ``keep`` columns."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    located = raw.select("*", F.col("_metadata.file_path").alias("source_file"))
    return normalize_rows(located, ("source_file", *keep))


def passing_files(rows: DataFrame) -> DataFrame:
    """Files that parsed without a reject and hold at least one position."""
    return rows.groupBy("source_file").agg(
        F.expr("count(*) AS positions"), F.expr("count(reject) AS rejects")
    ).withColumn("accepted", F.expr("positions > 0 AND rejects = 0"))


def land_uploads(rows: DataFrame, target: str) -> None:
    """Append only the rows of files that pass the gate."""
    good = passing_files(rows).filter("accepted").select("source_file")
    rows.join(good, "source_file", "left_semi").drop("reject").write.mode("append").parquet(target)


def inbox_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources in a tree of portfolio/kind/name.csv, where a source is a file or a folder of parts written by Spark.

    Partition-style folders (portfolio_id=7/kind=inbox/name=a.csv) count as well. A source is as new as its newest part.
    """
    place = r"(?:^|/)(?:portfolio_id=)?([^/]+)/(?:kind=)?([^/]+)/(?:name=)?([^/]+?\.csv)(?:/[^/]+)?$"
    part = lambda i, name: F.regexp_extract("relative", place, i).alias(name)
    found = list_files(spark, root, "*.csv").select(part(1, "portfolio_id"), part(2, "kind"), part(3, "name"), "modified")
    return found.filter("name <> ''").groupBy("portfolio_id", "kind", "name").agg(F.max("modified").alias("modified"))


def newest_source(sources: DataFrame, include_manual: bool = True) -> DataFrame:
    """One source per portfolio: kind precedence, then newest file, then name descending."""
    kinds = ", ".join(f"'{k}'" for k in SOURCE_ORDER)
    ranked = sources.withColumn("kind_rank", F.expr(f"array_position(array({kinds}), kind)"))
    if not include_manual:
        ranked = ranked.filter("name <> 'manual-portfolio.csv'")
    order = [F.col("kind_rank"), F.col("modified").desc(), F.col("name").desc()]
    return top_per_group(ranked, ["portfolio_id"], order, 1).drop("rank", "kind_rank")


def export_rows(positions: DataFrame) -> DataFrame:
    """The export layout: commas in names become spaces."""
    return positions.selectExpr(
        "ticker", "replace(name, ',', ' ') AS name", "shares", "cost AS cost_basis_per_share",
        "price AS current_price",
    )


def write_holdings_csv(positions: DataFrame, path: str) -> None:
    export_rows(positions).orderBy("ticker").write.mode("overwrite").option("header", True).csv(path)
