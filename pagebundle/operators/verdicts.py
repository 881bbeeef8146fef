"""Model replies as data: parsing, guarding, gating, and resolving their effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.functions import formats
from pagebundle.functions import json as js
from pagebundle.functions import text as tx
from pagebundle.functions.bind import bind
from pagebundle.operators import rules
from pagebundle.operators import segments as sg
from pagebundle.operators.scan import join_ranges, page_block, prefix_scan
from pagebundle.sources import dictionary as dic
from pagebundle.staging import stage

VERDICT_SCHEMA = (
    "struct<isFirstPage:boolean,documentType:string,isKnownType:boolean,confidence:double,"
    "reasonCodes:array<string>,suggestedNewPatterns:array<string>>"
)
HINT_SCHEMA = (
    f"struct<verdict:{VERDICT_SCHEMA},guard:array<string>,accepted:boolean>"
)
_FIELDS = (
    "isFirstPage", "documentType", "isKnownType", "confidence", "reasonCodes",
    "suggestedNewPatterns",
)
# runs with more undecided pages than this are resolved by pointer jumping
_FOLD_LIMIT = 1000

DEFAULT_SYSTEM_TEMPLATE = (
    "Oceniasz pojedyncze strony w paczkach skanow. Odpowiadasz jednym obiektem JSON."
)
DEFAULT_USER_TEMPLATE = """\
Czy AKTUALNA_STRONA zaczyna nowy dokument, czy kontynuuje "{typ_biezacego_dokumentu}"?
Odpowiedz w formacie: {format_json}
ZNANE_TYPY={znane_typy}
POPRZEDNIA_STRONA={poprzednia_strona}
AKTUALNA_STRONA={aktualna_strona}
NASTEPNA_STRONA={nastepna_strona}
"""


# --- before the call --------------------------------------------------------------------

def _around(pages: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Pages with their neighbours' texts, all cut to what a prompt uses."""
    cut = pages.withColumn("text", F.substring("text", 1, fixed.CURRENT_CHARS))
    return sg.page_context(cut, cfg, fixed.PREVIOUS_CHARS, fixed.NEXT_CHARS)


def _context(around: DataFrame, current_type: Column, patterns: DataFrame) -> DataFrame:
    current = F.coalesce(current_type, F.lit(""))
    tenant = ["dict_id"] if "dict_id" in around.columns else []
    return dic.with_known_types(around, patterns).select(
        *tenant, "bundle_id", "page_number",
        tx.json_string_array(F.col("known_types")).alias("znane_typy"),
        F.when(current == "", fixed.NO_CURRENT_TYPE).otherwise(current)
        .alias("typ_biezacego_dokumentu"),
        F.col("previous_text").alias("poprzednia_strona"),
        F.col("text").alias("aktualna_strona"),
        F.col("next_text").alias("nastepna_strona"),
        F.lit(fixed.VERDICT_FORMAT).alias("format_json"),
    )


def verdict_context(
    pages: DataFrame, current_type: Column, patterns: DataFrame, cfg: SplitConfig
) -> DataFrame:
    """The six strings a prompt may use, per page."""
    return _context(_around(pages, cfg), current_type, patterns)


def pending_prompts(
    pages: DataFrame,
    states: DataFrame,
    patterns: DataFrame,
    cfg: SplitConfig,
    user_template: str | None = None,
    system_template: str | None = None,
) -> DataFrame:
    """(bundle_id, page_number, current_type, system_prompt, user_prompt) of the pages to ask about.

    Only texts cut to a prompt's length take part in the joins.
    """
    asked = pending_verdicts(states).withColumnRenamed("current_type", "_asked_type")
    # states of a split by tenants name the dictionary too
    page = [c for c in ("dict_id", "bundle_id", "page_number") if c in asked.columns and c in pages.columns]
    around = _around(pages, cfg).join(asked, page)
    return _context(around, F.col("_asked_type"), patterns).select(
        *page,
        F.when(F.col("typ_biezacego_dokumentu") == fixed.NO_CURRENT_TYPE, "")
        .otherwise(F.col("typ_biezacego_dokumentu")).alias("current_type"),
        render_prompt(system_template, DEFAULT_SYSTEM_TEMPLATE).alias("system_prompt"),
        render_prompt(user_template).alias("user_prompt"),
    )


CONTEXT_FIELDS = (
    "znane_typy", "typ_biezacego_dokumentu", "poprzednia_strona", "aktualna_strona",
    "nastepna_strona", "format_json",
)


def render_prompt(template: str | None, default: str = DEFAULT_USER_TEMPLATE) -> Column:
    """{name} placeholders over the context columns, with the formats of ``functions.formats``.

    A faulty template yields the default, as does one that indexes a character that a
    row's text does not have.
    """
    usual = formats.compile_template(default, CONTEXT_FIELDS)[0]
    try:
        text, fits = formats.compile_template(default if template is None else template, CONTEXT_FIELDS)
    except ValueError:
        return usual
    return F.when(fits, text).otherwise(usual)


def template_warnings(spark: SparkSession, templates: dict[str, str | None]) -> DataFrame:
    """(template, fault) of the named templates for which the default is used."""
    faults = [
        (name, formats.template_fault(template, CONTEXT_FIELDS))
        for name, template in templates.items() if template is not None
    ]
    return spark.createDataFrame([f for f in faults if f[1]], "template string, fault string")


# --- after the call ---------------------------------------------------------------------

def extract_json(content: Column) -> Column:
    """From the first opening to the last closing brace; null when there is none."""
    start = F.instr(content, "{")
    end = F.length(content) - F.instr(F.reverse(content), "}") + 1
    found = (start > 0) & (F.instr(content, "}") > 0) & (end >= start)
    return F.when(found, F.substring(content, start, end - start + 1))


def normalize_confidence(value: Column) -> Column:
    """Percentages become shares; negatives are invalid (null)."""
    return (
        F.when(value < 0, F.lit(None))
        .when(value > 100, F.lit(1.0))
        .when(value > 1, value / 100)
        .otherwise(value)
    ).cast("double")


def _flag(item: Column) -> Column:
    def read(word: Column, number: Column) -> Column:
        return (
            F.when(word.isin("true", "1", "t", "yes", "y", "on"), True)
            .when(word.isin("false", "0", "f", "no", "n", "off"), False)
            .when(item["kind"].isin("BOOLEAN", "NUMBER") & number.isin(0.0, 1.0), number == 1.0)
        )

    both = F.struct(F.lower(js.as_text(item)).alias("word"), js.as_number(item).alias("number"))
    return bind(both, lambda x: read(x["word"], x["number"]))


def _confidence(item: Column) -> Column:
    """Only numbers may be percentages; a text must hold a share."""
    quoted = item["kind"] == "STRING"
    return bind(
        js.as_number(item),
        lambda number: F.when(quoted & number.between(0, 1) & ~F.isnan(number), number).when(
            ~quoted, normalize_confidence(number)
        ),
    )


def parse_verdict(content: Column) -> Column:
    """Verdict struct, or null when the reply is unusable.

    The part from the first to the last brace must be one JSON object, each field of its
    kind; documentType may be left out or be null, false, zero or empty.
    """

    def build(r: Column) -> Column:
        named = r["documentType"]
        document_type = F.when(js.is_blank(named), F.lit("")).otherwise(js.as_text(named))
        verdict = F.struct(
            _flag(r["isFirstPage"]).alias("isFirstPage"),
            document_type.alias("documentType"),
            _flag(r["isKnownType"]).alias("isKnownType"),
            _confidence(r["confidence"]).alias("confidence"),
            js.as_texts(r["reasonCodes"]).alias("reasonCodes"),
            js.as_texts(r["suggestedNewPatterns"]).alias("suggestedNewPatterns"),
        )
        return bind(verdict, lambda v: F.when(_complete(v), v))

    return bind(js.fields(js.parse_one(extract_json(content)), _FIELDS), build)


def _complete(verdict: Column) -> Column:
    return reduce(lambda ok, name: ok & verdict[name].isNotNull(), _FIELDS, F.lit(True))


def verdict_guard(verdict: Column, current_type: Column, known: Column) -> Column:
    """Reasons why a verdict contradicts itself or its context (empty = consistent)."""
    doc_type = verdict["documentType"]
    continuation = ~verdict["isFirstPage"]
    return F.array_compact(
        F.array(
            F.when(continuation & (current_type == ""), fixed.GUARD_NO_CURRENT).when(
                continuation & (doc_type != "") & (doc_type != current_type),
                F.format_string(fixed.GUARD_OTHER_TYPE, doc_type, current_type),
            ),
            F.when(
                verdict["isKnownType"] & ~F.array_contains(known, doc_type),
                F.format_string(fixed.GUARD_NOT_KNOWN, doc_type),
            ),
        )
    )


def is_accepted(verdict: Column, guard: Column, cfg: SplitConfig) -> Column:
    return F.coalesce(
        (verdict["documentType"] != "")
        & (F.size(guard) == 0)
        & (verdict["confidence"] >= cfg.min_review_confidence),
        F.lit(False),
    )


def judged_verdicts(responses: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """(bundle_id, page_number, current_type, content) -> hint struct per row.

    Replies with a dict_id are held against the types of their own dictionary.
    """
    known = F.col("known_types")
    typed = dic.with_known_types(responses, patterns)
    # Generated, not projected: no condition on the verdict makes Spark parse a reply again.
    verdicts = F.explode(F.array(parse_verdict(F.col("content")))).alias("verdict")
    return (
        typed.select("*", verdicts)
        .withColumn(
            "guard",
            F.when(
                F.col("verdict").isNotNull(),
                verdict_guard(F.col("verdict"), F.col("current_type"), known),
            ),
        )
        .select(
            *[c for c in responses.columns if c == "dict_id"], "bundle_id", "page_number", "current_type",
            F.struct(
                "verdict", "guard",
                is_accepted(F.col("verdict"), F.col("guard"), cfg).alias("accepted"),
            ).alias("hint"),
        )
    )


# --- effect on segmentation ---------------------------------------------------------------

def _switches(facts: DataFrame, judged: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Pages that open a new document *if* their stored current type is the real one.

    A run reaches from one rule-made first page to the next; inside it only these
    rows can change the current type, and runs do not influence each other.
    """
    runs = prefix_scan(
        facts,
        ["bundle_id"],
        ["page_number"],
        page_block("page_number", cfg.block_pages),
        sums={"run": F.col("is_first").cast("int")},
        lasts={"run_type": F.when(F.col("is_first"), F.col("document_type"))},
    ).where("NOT is_first AND NOT removable AND NOT is_empty")
    openings = judged.where("hint.accepted AND hint.verdict.isFirstPage").select(
        "bundle_id", "page_number", "current_type",
        F.col("hint.verdict.documentType").alias("new_type"),
    )
    in_phrase = (F.col("current_type") != "") & rules.has_affinity(
        F.col("affinities"), F.col("current_type")
    )
    return openings.join(runs, ["bundle_id", "page_number"]).where(~in_phrase).select(
        "bundle_id", "run", "page_number", "current_type", "new_type",
        F.coalesce("run_type", F.lit("")).alias("run_type"),
    )


def _fold_short_runs(switches: DataFrame) -> DataFrame:
    """Walk each run's switches in page order (bounded number per run)."""
    zero = F.struct(
        F.col("run_type").alias("type"), F.lit(0).alias("page"),
        F.array().cast("array<struct<page_number:int,current_type:string>>").alias("taken"),
    )

    def step(acc: Column, s: Column) -> Column:
        fires = (s["current_type"] == acc["type"]) & (s["page_number"] > acc["page"])
        return F.when(
            fires,
            F.struct(
                s["new_type"].alias("type"), s["page_number"].alias("page"),
                F.concat(
                    acc["taken"], F.array(F.struct(s["page_number"], s["current_type"]))
                ).alias("taken"),
            ),
        ).otherwise(acc)

    ordered = F.array_sort(
        F.collect_list(F.struct("page_number", "current_type", "new_type"))
    )
    walked = (
        switches.groupBy("bundle_id", "run", "run_type")
        .agg(ordered.alias("steps"))
        .select("bundle_id", F.aggregate("steps", zero, step, lambda a: a["taken"]).alias("taken"))
    )
    return walked.select("bundle_id", F.inline("taken"))


def _jump_long_runs(switches: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Pointer jumping: doubling the reach of every switch's successor each round.

    The successor of a switch is the next page of its run whose stored current
    type equals the type it opens. Rounds grow with the logarithm of the longest
    chain; every join is on a unique node key, so hot bundles spread.
    """
    roots = switches.select("bundle_id", "run", "run_type").distinct().select(
        "bundle_id", "run", F.lit(0).alias("page_number"), F.col("run_type").alias("key_type"),
        F.lit("").alias("current_type"), F.lit(True).alias("source"),
    )
    sources = switches.select(
        "bundle_id", "run", "page_number", F.col("new_type").alias("key_type"),
        "current_type", F.lit(True).alias("source"),
    )
    targets = switches.select(
        "bundle_id", "run", "page_number", F.col("current_type").alias("key_type"),
        "current_type", F.lit(False).alias("source"),
    )
    # back to front; at equal pages sources come first and so never see that page
    marks = (
        roots.unionByName(sources).unionByName(targets)
        .withColumn("back", -F.col("page_number"))
        .withColumn("role", F.when(F.col("source"), F.lit(0)).otherwise(F.lit(1)))
    )
    linked = prefix_scan(
        stage(marks, "switch_marks"),
        ["bundle_id", "run", "key_type"],
        ["back", "role", "current_type"],
        F.floor(F.col("back") / F.lit(cfg.block_pages)).cast("long"),
        lasts={"next_page": F.when(~F.col("source"), F.col("page_number"))},
    ).where("source")
    # a node is a switch: its page and the current type it is stored under
    nodes = stage(
        linked.select(
            "bundle_id", "page_number", "current_type",
            F.when(F.col("page_number") == 0, F.col("run")).alias("root_of"),
            F.col("next_page"),
            F.when(F.col("next_page").isNotNull(), F.col("key_type")).alias("next_type"),
            (F.col("page_number") == 0).alias("reached"),
        ),
        "switch_nodes",
    )
    key = ["bundle_id", "page_number", "current_type"]
    while not nodes.where("reached AND next_page IS NOT NULL").isEmpty():
        jump = nodes.where("page_number > 0").select(
            "bundle_id", F.col("page_number").alias("next_page"),
            F.col("current_type").alias("next_type"),
            F.col("next_page").alias("far_page"), F.col("next_type").alias("far_type"),
        )
        hit = (
            nodes.where("reached AND next_page IS NOT NULL")
            .select(
                "bundle_id", F.col("next_page").alias("page_number"),
                F.col("next_type").alias("current_type"), F.lit(True).alias("hit"),
            )
            .distinct()
        )
        nodes = stage(
            nodes.join(jump, ["bundle_id", "next_page", "next_type"], "left")
            .join(hit, key, "left")
            .select(
                *key, "root_of",
                F.col("far_page").alias("next_page"), F.col("far_type").alias("next_type"),
                (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"),
            ),
            "switch_nodes",
        )
    return nodes.where("reached AND page_number > 0").select(*key)


def opened_by_verdict(
    facts: DataFrame, judged: DataFrame, cfg: SplitConfig, fold_limit: int = _FOLD_LIMIT
) -> DataFrame:
    """(bundle_id, page_number, current_type) of verdicts that really open a document."""
    switches = stage(_switches(facts, judged, cfg), "verdict_switches")
    runs = switches.groupBy("bundle_id", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("page_number").alias("start_page"),
        F.max("page_number").alias("end_page"),
    )
    long_runs = runs.where(F.col("n") > fold_limit).drop("n", "run")
    if long_runs.isEmpty():
        return _fold_short_runs(switches)
    short = join_ranges(switches, long_runs, cfg.block_pages, "left_anti")
    long = stage(join_ranges(switches, long_runs, cfg.block_pages, "left_semi"), "long_runs")
    return _fold_short_runs(short).unionByName(_jump_long_runs(long, cfg))


def verdict_states(
    facts: DataFrame, judged: DataFrame, cfg: SplitConfig, fold_limit: int = _FOLD_LIMIT
) -> DataFrame:
    """Page states with verdicts taken into account (``facts``: a table with removable).

    ``hint`` is the stored verdict of a page under its actual current type.
    """
    key = ["bundle_id", "page_number"]
    judged = stage(judged, "judged")
    opened = opened_by_verdict(facts, judged, cfg, fold_limit)
    chosen = judged.join(opened, [*key, "current_type"], "left_semi").select(
        *key, F.col("hint.verdict").alias("v")
    )
    merged = stage(
        facts.join(chosen, key, "left").select(
            *key,
            (F.col("is_first") | F.col("v").isNotNull()).alias("is_first"),
            F.coalesce("v.documentType", "document_type").alias("document_type"),
            F.coalesce("v.confidence", "confidence").alias("confidence"),
            F.when(
                F.col("v").isNotNull(),
                F.transform("v.reasonCodes", lambda c: F.concat(F.lit(fixed.VERDICT_SIGNAL), c)),
            ).otherwise(F.col("signals")).alias("signals"),
            "affinities", "is_empty", "confirmed_empty", "removable",
            F.col("v").isNotNull().alias("by_verdict"),
        ),
        "facts_with_verdicts",
    )
    states = sg.page_states(merged, cfg)
    asked = judged.select(*key, F.col("current_type").alias("_type"), "hint")
    return (
        states.withColumn("_type", F.coalesce("current_type", F.lit("")))
        .join(asked, [*key, "_type"], "left")
        .withColumn("hint", F.when((F.col("kind") == "unmatched") & ~F.col("is_empty"), F.col("hint")))
        .withColumn(
            "kind",
            F.when(
                F.col("known") & F.coalesce("hint.accepted", F.lit(False))
                & ~F.col("hint.verdict.isFirstPage"),
                F.lit("verdict"),
            ).otherwise(F.col("kind")),
        )
        .drop("_type")
    )


def pending_verdicts(states: DataFrame) -> DataFrame:
    """Pages whose decision would ask the model, for which no reply is stored yet."""
    tenant = ["dict_id"] if "dict_id" in states.columns else []
    return states.where("kind = 'unmatched' AND NOT is_empty AND hint IS NULL").select(
        *tenant, "bundle_id", "page_number", F.coalesce("current_type", F.lit("")).alias("current_type")
    )
