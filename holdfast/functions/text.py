"""Prompt text, reply parsing, digests, scanning and small string helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fees as fee
from holdfast.functions import money

PROMPT_ARMS = ("bare", "policy", "scaffold")

# The wording of the advisor prompt.
TASK_LINE = "You are an investment assistant proposing additions to an existing equity portfolio."
NO_OWNED_LINE = "Do not recommend already-owned tickers."
OWNED_OK_LINE = "You may recommend already-owned tickers when they are in the allowed universe."
CITE_LINE = "Cite only fact ids provided."
FEWEST_LINE = "Deploy in the fewest tranches; do not split unless it is fee-neutral."
AMOUNTS_LINE = 'Include an "amounts" array with one USD amount per ticker.'
NO_AMOUNTS_LINE = 'Do not include an "amounts" field unless explicitly required.'
FORMAT_LINE = (
    'Reply with one JSON object and nothing else, in the form {"tickers": ["AAA", "BBB"], '
    '"amounts": [500.0, 750.0], "cited_fact_ids": ["id1"]}. '
)
ARITHMETIC_LEAD = "Fee arithmetic (already computed for you): a single order deploying your USD "


def usd(amount: str) -> str:
    return money.fixed(amount)


def prompt(arm: str, fees: fee.FeeSchedule = fee.DEFAULT_FEES) -> str:
    """Prompt of one arm over the scenario columns; 'policy' and 'scaffold' extend 'bare'."""
    if arm not in PROMPT_ARMS:
        raise ValueError(f"unknown prompt arm: {arm}")
    rule = (
        f"The fee is USD {fees.cost:.2f} per started USD {fees.tranche:.0f} tranche, and the minimum "
        f"economic order is USD {fees.floor:.2f}. {FEWEST_LINE}"
    )
    facts = "if(size(available_fact_ids) = 0, 'none', array_join(available_fact_ids, ', '))"
    lines = [
        f"'{TASK_LINE}'",
        f"concat('Cash available: USD ', {usd('cash')}, '.')",
        "concat('Allowed universe: ', array_join(allowed_tickers, ', '), '.')",
        "concat('Already owned: ', array_join(owned_tickers, ', '), '.')",
        "concat('Recommend at most ', max_recommendations, ' tickers.')",
        f"concat('Facts you may cite: ', {facts}, '.')",
    ]
    if arm != "bare":
        lines += [f"if(add_only, '{NO_OWNED_LINE}', '{OWNED_OK_LINE}')", f"'{CITE_LINE}'"]
    if arm == "policy":
        lines.append(f"'{rule}'")
    if arm == "scaffold":
        halves = f"{fee.order_fee('(cash / 2)', fees)} + {fee.order_fee('(cash - cash / 2)', fees)}"
        lines.append(
            f"concat('{ARITHMETIC_LEAD}', {usd('cash')}, ' pays USD ', {usd(fee.order_fee('cash', fees))}, "
            f"'; splitting it into two equal orders pays USD ', {usd(halves)}, '. {rule}')"
        )
    lines.append(f"concat('{FORMAT_LINE}', if(amounts_required, '{AMOUNTS_LINE}', '{NO_AMOUNTS_LINE}'))")
    newline = "chr(10)"
    return f"concat_ws({newline}, {', '.join(lines)})"


def json_span(text: str) -> str:
    """From the first '{' to the last '}', or null when there is no such span."""
    start = f"instr({text}, '{{')"
    end = f"(length({text}) - instr(reverse({text}), '}}') + 1)"
    found = f"{start} > 0 AND instr(reverse({text}), '}}') > 0 AND {end} >= {start}"
    return f"if({found}, substr({text}, {start}, {end} - {start} + 1), NULL)"


def parse_replies(replies: DataFrame, column: str = "raw_response") -> DataFrame:
    """Add parsed tickers, amounts and cited facts, or the reason a reply is unusable.

    The JSON is read as a VARIANT and every field's type is checked, so a malformed field is
    reported rather than turned into null.
    """
    blanks = r"' \t\n\r\f'"

    def kind(path: str) -> str:
        return f"schema_of_variant(variant_get(doc, '{path}', 'variant'))"

    def string_list(path: str) -> str:
        return f"{kind(path)} IN ('ARRAY<STRING>', 'ARRAY<VOID>')"

    def clean(path: str, wrap: str) -> str:
        values = f"coalesce(variant_get(doc, '{path}', 'array<string>'), cast(array() AS array<string>))"
        return f"filter(transform({values}, t -> {wrap}), t -> t <> '')"

    tickers, cited, amounts = "$.tickers", "$.cited_fact_ids", "$.amounts"
    has = lambda path: f"variant_get(doc, '{path}', 'variant') IS NOT NULL"
    number = f"({kind(amounts)} RLIKE '^ARRAY<(BIGINT|DOUBLE|DECIMAL.*|VOID)>$')"
    values = f"coalesce(try_variant_get(doc, '{amounts}', 'array<double>'), cast(array() AS array<double>))"
    infinite = f"exists({values}, x -> isnan(x) OR abs(x) = double('infinity'))"
    error = (
        "CASE WHEN span IS NULL THEN 'no JSON object found in model response' "
        "WHEN doc IS NULL THEN 'model response is not valid JSON' "
        f"WHEN NOT ({has(tickers)}) OR {kind(tickers)} NOT LIKE 'ARRAY%' THEN 'model response has no tickers list' "
        f"WHEN NOT ({string_list(tickers)}) THEN 'model response tickers must contain only strings' "
        f"WHEN {has(cited)} AND NOT ({string_list(cited)}) THEN 'model response cited_fact_ids must be a list of strings' "
        f"WHEN {has(amounts)} AND NOT {number} THEN 'model response amounts must be a list of numbers' "
        f"WHEN {has(amounts)} AND {infinite} THEN 'model response amounts must be finite' END"
    )
    staged = replies.selectExpr("*", f"{json_span(column)} AS span").selectExpr(
        "*", "try_parse_json(span) AS doc"
    ).selectExpr("*", f"{error} AS parse_error")
    ok = "parse_error IS NULL"
    return staged.selectExpr(
        "*",
        f"if({ok}, {clean(tickers, f'upper(btrim(t, {blanks}))')}, cast(array() AS array<string>)) AS tickers",
        f"if({ok}, {values}, cast(array() AS array<double>)) AS amounts",
        f"if({ok}, {clean(cited, f'btrim(t, {blanks})')}, cast(array() AS array<string>)) AS cited_fact_ids",
    ).drop("span", "doc")


def digest(text: str) -> str:
    return f"sha2({text}, 256)"


def slug(text: str) -> str:
    """File-safe name: other characters become underscores, edges trimmed, never empty."""
    safe = f"btrim(regexp_replace(btrim({text}), '[^A-Za-z0-9_.-]+', '_'), '._')"
    return f"coalesce(nullif({safe}, ''), 'unnamed')"


def token_estimate(text: str, chars_per_token: float = 4.0) -> str:
    return f"ceil(length({text}) / {chars_per_token}D)"


def usd_label(amount: str) -> str:
    """Dollar label: four decimals below one cent, otherwise two."""
    return f"concat('$', if({money.half_away(amount, 4)} < 0.01D, {money.fixed(amount, 4)}, {money.fixed(amount)}))"


def percent_text(text: str) -> str:
    return f"cast(replace({text}, '%', '') AS double)"


def quote_change(price: str, previous: str) -> str:
    """Change percent from the previous close; zero when there is none."""
    return f"if({previous} <> 0, ({price} - {previous}) / {previous} * 100, 0D)"


# Labelled patterns of the secret and privacy scan.
SCAN_PATTERNS = {
    "local home path": r"/Users/[^\"'\s:)]+",
    "OpenAI-style key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "GitHub token": r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "private key block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "token assignment": r'token = "[0-9a-f]+"',
}
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
ALLOWED_EMAILS = ("anonymous@example.com", "reviewer@example.com", "user@example.com")


def compact(value: str, limit: int = 96) -> str:
    """Collapse white space and shorten long findings with an ellipsis."""
    flat = f"btrim(regexp_replace({value}, '\\\\s+', ' '))"
    return f"if(length({flat}) <= {limit}, {flat}, concat(substr({flat}, 1, {limit - 3}), '...'))"


def scan_documents(
    documents: DataFrame,
    patterns: dict[str, str] | None = None,
    allowed_emails: Sequence[str] = ALLOWED_EMAILS,
    exempt: str = "false",
) -> DataFrame:
    """Findings (document, label, line, value) over whole texts, scanned line by line.

    Documents without any match are dropped before they are split into lines; patterns must
    not span lines. ``exempt`` is a row condition that skips the e-mail check.
    """
    wanted = {**(patterns or SCAN_PATTERNS), "email": EMAIL}
    hit = F.col("text").contains("@") & F.col("text").rlike(EMAIL)
    for pattern in (patterns or SCAN_PATTERNS).values():
        hit = hit | F.col("text").rlike(pattern)
    lines = documents.filter(hit).selectExpr("*", "posexplode(split(text, chr(10))) AS (line_index, line)").drop("text")
    kinds = []
    for label, pattern in wanted.items():
        hits = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        kinds.append(F.struct(F.lit(label).alias("label"), hits.alias("hits")))
    found = lines.select("*", F.array(*kinds).alias("k")).withColumn("k", F.explode("k")).filter(
        "size(k.hits) > 0"
    ).selectExpr("*", "k.label AS label", "explode(k.hits) AS hit")
    names = ", ".join(f"'{e}'" for e in allowed_emails)
    kept = found.filter(f"label <> 'email' OR (NOT ({exempt}) AND lower(hit) NOT IN ({names}))")
    return kept.selectExpr(
        "doc_id", "if(label = 'email', 'non-anonymous email', label) AS label", "line_index + 1 AS line",
        f"if(label = 'email', lower(hit), {compact('hit')}) AS value",
    )
