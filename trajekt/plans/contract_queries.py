"""I9-I12: contract checks. Stand-ins: every supplier has a rule pack, every part a movement specification, every order a timeline of the
specification of its customer's number, every customer three profiles; each value of a document is at fault for some keys.

A document is declared once, as SQL text that both engines read, and becomes nested columns here and flat tables for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions.thresholds import RANGES, THRESHOLDS
from ..operators import contracts as C
from . import tables as T
from .registry import query

EVERY = 29
MOVEMENTS = "LIST('M1', 'M2', 'M3', 'M4', 'M5', 'M6', 'M7')"
EMPTY = "EMPTY()"


def spark_text(text: str) -> str:
    if text.startswith("SUB("):
        whole, first, last = text[4:-1].rsplit(", ", 2)
        text = f"slice({whole}, {first}, greatest({last} - ({first}) + 1, 0))"
    text = text.replace("EMPTY()", "array_remove(array('x'), 'x')").replace("LIST(", "array(")
    return re.sub(r"SHA\((.+?)\)", r"sha2(CAST(\1 AS STRING), 256)", text)


def duck_text(text: str) -> str:
    text = text.replace("SUB(", "list_slice(").replace("EMPTY()", "[]::VARCHAR[]").replace("LIST(", "list_value(")
    return re.sub(r"SHA\((.+?)\)", r"sha256(CAST(\1 AS VARCHAR))", text)


class Documents:
    """Documents of one kind: fields (name, right value, faulty value) of the document and of the elements of its parts."""

    def __init__(self, name: str, source: str, key: str, fields: Sequence[tuple[str, str, str | None]], parts: dict[str, tuple[str, Sequence[tuple[str, str, str | None]]]], also: Sequence[str] = ()):
        self.name, self.source, self.key, self.fields, self.parts, self.also = name, source, key, fields, parts, also

    def _values(self, fields, render, element: str = "") -> list[tuple[str, str]]:
        """(name, text) of each field; which keys have the faulty value depends on the field's place."""
        place = 1000 * len(element) + sum(map(ord, element))
        when = lambda n: f"(k * 7 + {'c * 3 + ' if element else ''}{place + n} * 13) % {EVERY} = 0"
        out = []
        for n, (name, right, faulty) in enumerate(fields):
            if faulty is None:
                out.append((name, render(right)))
            else:
                out.append((name, f"CASE WHEN {when(n)} THEN {render(faulty)} ELSE {render(right)} END"))
        return out

    def frame(self, spark, sf):
        rows = T.read(spark, sf, self.source).select(F.col(self.key).alias("k"), *[F.expr(a) for a in self.also]).distinct()
        columns = [F.expr(text).alias(name) for name, text in self._values(self.fields, spark_text)]
        for part, (count, fields) in self.parts.items():
            members = ", ".join(f"'{name}', {text}" for name, text in self._values(fields, spark_text, part))
            columns.append(F.expr(f"transform(slice(sequence(1, 40), 1, CAST({count} AS INT)), c -> named_struct({members}))").alias(part))
        return rows.select("*", *columns)

    def sql(self) -> str:
        base = f"{self.name}0 AS (SELECT DISTINCT {self.key} AS k{''.join(', ' + a for a in self.also)} FROM {self.source})"
        own = ", ".join(f"{text} AS {name}" for name, text in self._values(self.fields, duck_text))
        tables = [base, f"{self.name} AS (SELECT *, {own} FROM {self.name}0)"]
        for part, (count, fields) in self.parts.items():
            members = ", ".join(f"{text} AS {name}" for name, text in self._values(fields, duck_text, part))
            tables.append(f"{self.name}_{part} AS (SELECT k, c, {members} FROM {self.name}0, unnest(range(1, CAST({count} AS INT) + 1)) u(c))")
        return ", ".join(tables)


# condition on a value: in Spark, and as text for the oracle
_TEXT = r"({f} IS NULL OR NOT regexp_matches({f}, '\S'))"
KINDS = {
    "text": (C.no_text, _TEXT),
    "identifier": (C.no_identifier, _TEXT[:-1] + r" OR regexp_matches({f}, '\s'))"),
    "positive": (C.not_positive, "({f} IS NULL OR {f} <= 0)"),
    "nonnegative": (C.negative, "({f} IS NULL OR {f} < 0)"),
    "probability": (C.no_probability, "({f} IS NULL OR {f} < 0 OR {f} > 1)"),
    "finite": (C.not_finite, "{f} IS NULL"),
    "digest": (C.no_digest, "({f} IS NOT NULL AND NOT regexp_full_match({f}, '[0-9a-fA-F]{{64}}'))"),
    "texts": (C.no_texts, "({f} IS NULL OR len(list_filter({f}, lambda v: NOT regexp_matches(v, '\\S'))) > 0)"),
    "some_texts": (C.no_texts_at_all, "({f} IS NULL OR len({f}) = 0 OR len(list_filter({f}, lambda v: NOT regexp_matches(v, '\\S'))) > 0)"),
    "optional_text": (lambda v: v.isNotNull() & C.no_text(v), r"({f} IS NOT NULL AND NOT regexp_matches({f}, '\S'))"),
}


def values(part: str | None, **kinds: str) -> list[tuple[str, str, str | None, str]]:
    """(violation, field, part, kind) of fields of a kind, or of the allowed values 'a|b|c'."""
    return [(f"{name}:{kind if kind in KINDS else 'unsupported'}", name, part, kind) for name, kind in kinds.items()]


def compiled(rows: Sequence[tuple[str, str, str | None, str]]) -> list[C.Check]:
    return [C.field(v, name, KINDS[kind][0] if kind in KINDS else C.not_among(*[int(a) if a.isdigit() else a for a in kind.split("|")]), part) for v, name, part, kind in rows]


def item(part: str | None) -> str:
    return f"'{part}[' || c || ']'" if part else "''"


def found(table: str, part: str | None, violation: str, condition: str) -> str:
    return f"SELECT k, {item(part)} AS item, '{violation}' AS violation FROM {table}{'_' + part if part else ''} d WHERE {condition}"


def oracle(docs: Documents, rows: Sequence[tuple[str, str, str | None, str]], more: Sequence[str]) -> str:
    out = []
    for violation, name, part, kind in rows:
        listed = "', '".join(kind.split("|"))
        condition = KINDS[kind][1].format(f=name) if kind in KINDS else f"({name} IS NULL OR CAST({name} AS VARCHAR) NOT IN ('{listed}'))"
        out.append(found(docs.name, part, violation, condition))
    return " UNION ALL ".join([*out, *more])


def sql_repeated(table: str, part: str, violation: str, key: str) -> str:
    return f"SELECT k, {item(part)}, '{violation}' FROM {table}_{part} d WHERE EXISTS (SELECT 1 FROM {table}_{part} e WHERE e.k = d.k AND e.c < d.c AND e.{key} = d.{key})"


def sql_dangling(table: str, part: str, violation: str, refs: str, sources: str = "sources") -> str:
    return f"SELECT DISTINCT k, {item(part)}, '{violation}' FROM (SELECT k, c, unnest({refs}) AS r FROM {table}_{part}) d WHERE NOT EXISTS (SELECT 1 FROM {table}_{sources} s WHERE s.k = d.k AND s.source_id = split_part(r, '#', 1))"


def sql_members(table: str, part: str, violation: str, key: str, expected: Sequence[str]) -> str:
    return f"SELECT d.k, '', '{violation}' FROM {table} d JOIN {table}_{part} p USING (k) GROUP BY d.k HAVING list_sort(list(DISTINCT p.{key})) <> {sorted(expected)!r}"


def sql_sum(table: str, part: str, violation: str, value: str, budget: str) -> str:
    return f"SELECT d.k, '', '{violation}' FROM {table} d JOIN (SELECT k, sum({value}) AS s FROM {table}_{part} GROUP BY k) p USING (k) WHERE abs(s - {budget}) > 1e-9 + 1e-5 * abs({budget})"


def sources_of(owner):
    return lambda: F.transform(owner, lambda s: s["source_id"])


SOURCES = (
    "2",
    [("source_id", "concat('S', c)", "CASE k % 2 WHEN 0 THEN 'S1' ELSE 'S 1' END"), ("authority", "'office'", "' '"), ("title", "concat('title ', c)", "''"), ("url", "'https://example.org'", "CAST(NULL AS STRING)"), ("effective_date", "'2024-01-01'", "''"), ("accessed_at", "'2024-02-01'", "''"),
     ("language", "'en'", "''"), ("access", "'public'", "'secret'"), ("content_sha256", "SHA(k * 10 + c)", "'abc'"), ("sections", "LIST('1', '2')", EMPTY)],
)
SOURCE_VALUES = values("sources", source_id="identifier", authority="text", title="text", url="text", effective_date="text", accessed_at="text", language="text", access="public|paid|restricted", content_sha256="digest", sections="some_texts")
REFS = ("source_refs", "LIST('S1#a', 'S2')", f"CASE k % 2 WHEN 0 THEN LIST('S9#b') ELSE {EMPTY} END")


def kinds_of(*names: str) -> str:
    return "CASE c " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1)) + " END"


# ---------------------------------------------------------------- I9 rule packs

MINOR = ("minor", "major", "restart")
COMPONENTS = ("speed_and_power", "rhythm_and_tempo", "expression_of_energy")
FINALS = ("time_violation", "boundary_crossing")
PACKS = Documents(
    "pack", "supplier", "s_suppkey",
    [("schema_version", "1", "2"), ("rule_pack_id", "concat('pack_', k)", "concat('pack ', k)"), ("version", "'1.0'", "'  '"), ("status", "'active'", "'live'"), ("authority", "'office'", "''"), ("discipline", "'recognized_poomsae'", "'freestyle'"),
     ("effective_date", "'2024-01-01'", "CAST(NULL AS STRING)"), ("accessed_at", "'2024-02-01'", "''"), ("total_score", "CAST(10 AS DOUBLE)", "CASE k % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(10.5 AS DOUBLE) END"), ("initial_score", "CAST(4 AS DOUBLE)", "CAST(-1 AS DOUBLE)"),
     ("presentation_reserved_score", "CAST(6 AS DOUBLE)", "CASE k % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(6.25 AS DOUBLE) END"), ("presentation_total", "CAST(6 AS DOUBLE)", "CASE k % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END"), ("scoring_mode", "'manual'", "''"), ("scoring_note", "'note'", "''")],
    {
        "sources": SOURCES,
        "deductions": ("3", [("kind", kinds_of(*MINOR), "'other'"), ("rule_id", "concat('R', c)", "'R 1'"), ("amount", "c * CAST(0.1 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("scope", "'individual_movement'", "'match'"), ("definition", "'text'", "''"), REFS]),
        "examples": ("k % 3", [("kind", "'minor'", "'major'"), ("example", "concat('minor:E', c)", "'minor:E1'"), ("id", "concat('E', c)", "'E 1'"), ("text", "'text'", "''"), ("measurable", "'pose_only'", "'never'"), ("source_refs", "LIST('S1')", "LIST('S7')")]),
        "components": ("3 * CAST(k % 4 > 0 AS INT)", [("component", kinds_of(*COMPONENTS), "'style'"), ("score", "CAST(2 AS DOUBLE)", "CAST(-2 AS DOUBLE)"), REFS]),
        "finals": ("2 * CAST(k % 5 > 0 AS INT)", [("kind", kinds_of(*FINALS), "'other'"), ("rule_id", "concat('F', c)", "''"), ("amount", "CAST(0.3 AS DOUBLE)", "CAST(-0.3 AS DOUBLE)"), ("applies_to", "'final_score'", "'accuracy'"), ("frequency", "'per_performance'", "'once'"),
                   ("scope", "'performance'", "'movement'"), ("definition", "'text'", "''"), REFS, ("source_ambiguity", "CAST(NULL AS STRING)", "' '")]),
    },
)
PACK_VALUES = [
    *values(None, schema_version="1", rule_pack_id="identifier", version="text", status="draft|active|retired", authority="text", discipline="recognized_poomsae", effective_date="text", accessed_at="text", total_score="nonnegative", initial_score="nonnegative",
            presentation_reserved_score="nonnegative", presentation_total="nonnegative", scoring_mode="text", scoring_note="text"),
    *SOURCE_VALUES,
    *values("deductions", rule_id="identifier", amount="positive", scope="individual_movement|performance", definition="text", source_refs="some_texts"),
    *values("examples", id="identifier", text="text", measurable="pose_only|pose_and_spec|audio_required", source_refs="some_texts"),
    *values("components", score="nonnegative", source_refs="some_texts"),
    *values("finals", rule_id="identifier", amount="positive", applies_to="final_score", frequency="per_performance", scope="performance", definition="text", source_refs="some_texts", source_ambiguity="optional_text"),
]
_REF_PARTS = ("deductions", "examples", "components", "finals")


def pack_checks() -> list[C.Check]:
    refs = lambda e: e["source_refs"]
    return [
        *compiled(PACK_VALUES), C.repeated("source_id:repeated", "sources", "source_id"), C.repeated("example:repeated", "examples", "example"),
        *[C.dangling("source_refs:unknown", part, refs, sources_of("sources")) for part in _REF_PARTS],
        C.Check("score_budget:mismatch", lambda: C.off(F.col("initial_score") + F.col("presentation_reserved_score"), F.col("total_score"))),
        C.Check("component_scores:mismatch", lambda: (F.size("components") > 0) & C.off(C.total("components", "score"), F.col("presentation_reserved_score"))),
        C.Check("presentation_total:mismatch", lambda: (F.size("components") > 0) & C.off(F.col("presentation_total"), F.col("presentation_reserved_score"))),
        C.wrong_members("deductions:members", "deductions", "kind", MINOR),
        C.Check("components:members", lambda: (F.size("components") > 0) & C.wrong_members("", "components", "component", COMPONENTS).bad()),
        C.Check("finals:members", lambda: (F.size("finals") > 0) & C.wrong_members("", "finals", "kind", FINALS).bad()),
    ]


PACK_SQL = [
    sql_repeated("pack", "sources", "source_id:repeated", "source_id"), sql_repeated("pack", "examples", "example:repeated", "example"),
    *[sql_dangling("pack", part, "source_refs:unknown", "source_refs") for part in _REF_PARTS],
    found("pack", None, "score_budget:mismatch", "abs(initial_score + presentation_reserved_score - total_score) > 1e-9 + 1e-5 * abs(total_score)"),
    sql_sum("pack", "components", "component_scores:mismatch", "score", "presentation_reserved_score"),
    found("pack", None, "presentation_total:mismatch", "abs(presentation_total - presentation_reserved_score) > 1e-9 + 1e-5 * abs(presentation_reserved_score) AND EXISTS (SELECT 1 FROM pack_components p WHERE p.k = d.k)"),
    sql_members("pack", "deductions", "deductions:members", "kind", MINOR), sql_members("pack", "components", "components:members", "component", COMPONENTS), sql_members("pack", "finals", "finals:members", "kind", FINALS),
]


@query("i9_rule_pack_checks", f"WITH {PACKS.sql()} {oracle(PACKS, PACK_VALUES, PACK_SQL)}")
def i9(spark, sf):
    """Rule packs: required values, unique keys, source references, exact members of each group, and sums that must meet their budget."""
    return C.violations(PACKS.frame(spark, sf), ["k"], pack_checks())


# ---------------------------------------------------------------- I10 movement specifications

SPECS = Documents(
    "spec", "part", "p_partkey",
    [("schema_version", "1", "3"), ("poomsae_id", "concat('spec_', k)", "''"), ("version", "'1'", "' '"), ("display_name", "'name'", "''"), ("rule_pack_id", "'pack_1'", "'pack 1'"), ("status", "CASE k % 3 WHEN 0 THEN 'draft' ELSE 'active' END", "'open'"),
     ("sequence_status", "CASE k % 3 WHEN 0 THEN 'source_transcribed' ELSE 'active' END", "CASE k % 2 WHEN 0 THEN 'source_inventory_incomplete' ELSE 'unknown' END"), ("blocked_reasons", EMPTY, "LIST('why', '')")],
    {
        "sources": SOURCES,
        "movements": ("k % 7", [("movement_id", "concat('M', c)", "CASE k % 2 WHEN 0 THEN 'M1' ELSE 'M 1' END"), ("sequence_index", "c", "c + 1"), ("display_name", "'name'", "''"), ("direction", "'north'", "''"), ("stance", "'walking'", "' '"), ("techniques", "LIST('t')", EMPTY),
                      ("phases", "LIST('preparation', 'execution', 'fixation')", "LIST('preparation', '')"), ("measurable_criteria", "LIST('a')", "LIST(' ')"), REFS]),
    },
)
SPEC_VALUES = [
    *values(None, schema_version="1", poomsae_id="identifier", version="text", display_name="text", rule_pack_id="identifier", status="draft|active|retired", sequence_status="source_inventory_incomplete|source_transcribed|active", blocked_reasons="texts"),
    *SOURCE_VALUES,
    *values("movements", movement_id="identifier", display_name="text", direction="text", stance="text", phases="some_texts", measurable_criteria="texts", source_refs="some_texts"),
]


def spec_checks() -> list[C.Check]:
    active = lambda: F.col("status") == "active"
    return [
        *compiled(SPEC_VALUES), C.repeated("source_id:repeated", "sources", "source_id"), C.repeated("movement_id:repeated", "movements", "movement_id"), C.out_of_sequence("sequence_index:not_contiguous", "movements", "sequence_index"),
        C.Check("techniques:empty", lambda e, i: F.size(e["techniques"]) == 0, "movements"), C.dangling("source_refs:unknown", "movements", lambda e: e["source_refs"], sources_of("sources")),
        C.if_then("active:no_active_sequence", active, lambda: (F.col("sequence_status") == "active") & (F.size("movements") > 0)),
        C.if_then("active:blocked", active, lambda: F.size("blocked_reasons") == 0),
        C.if_then("active_sequence:inactive_spec", lambda: F.col("sequence_status") == "active", active),
    ]


SPEC_SQL = [
    sql_repeated("spec", "sources", "source_id:repeated", "source_id"), sql_repeated("spec", "movements", "movement_id:repeated", "movement_id"), found("spec", "movements", "sequence_index:not_contiguous", "sequence_index <> c"),
    found("spec", "movements", "techniques:empty", "len(techniques) = 0"), sql_dangling("spec", "movements", "source_refs:unknown", "source_refs"),
    found("spec", None, "active:no_active_sequence", "status = 'active' AND (sequence_status <> 'active' OR k % 7 = 0)"), found("spec", None, "active:blocked", "status = 'active' AND len(blocked_reasons) > 0"),
    found("spec", None, "active_sequence:inactive_spec", "sequence_status = 'active' AND status <> 'active'"),
]


@query("i10_movement_spec_checks", f"WITH {SPECS.sql()} {oracle(SPECS, SPEC_VALUES, SPEC_SQL)}")
def i10(spark, sf):
    """Movement specifications: contiguous order, unique ids, references, and an active one unblocked with an active sequence."""
    return C.violations(SPECS.frame(spark, sf), ["k"], spec_checks())


# ---------------------------------------------------------------- I11 timelines

TIMELINES = Documents(
    "line", "orders", "o_orderkey",
    [("schema_version", "2", "1"), ("timeline_id", "concat('t', k)", "'t 1'"), ("poomsae_id", "concat('spec_', spec_k)", "'spec_0'"), ("poomsae_version", "'1'", "'2'"), ("status", "CASE k % 2 WHEN 0 THEN 'complete' ELSE 'draft' END", "'done'"), ("label_source", "'automatic'", "'guess'"),
     ("frame_index_space", "'sample_index'", "'time'"), ("frame_count", "1000", "0"), ("fps", "CAST(30 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("session_id", "'s1'", "'s 1'"), ("run_id", "'r1'", "''"), ("pose_file", "'pose.parquet'", "''"),
     ("pose_file_sha256", "CASE k % 5 WHEN 0 THEN CAST(NULL AS STRING) ELSE SHA(k) END", "'zz'"), ("recording_scope", "CASE WHEN n >= spec_k % 7 THEN 'complete_performance' ELSE 'partial_sequence' END", "'some'"),
     ("observed_movement_ids", f"SUB({MOVEMENTS}, 1, n)", f"CASE k % 3 WHEN 0 THEN {EMPTY} WHEN 1 THEN LIST('M2', 'M2') ELSE LIST('M1', ' ') END"), ("missing_movement_ids", f"SUB({MOVEMENTS}, n + 1, spec_k % 7)", "LIST('M7', ' ')"), ("source_end_reason", "CASE WHEN n >= spec_k % 7 THEN CAST(NULL AS STRING) ELSE 'cut' END", "''")],
    {
        "segments": ("1 + k % 4", [("sequence_index", "c", "c + 2"), ("movement_id", "concat('M', c)", "'M9'"), ("start_frame", "c * 100", "c * 100 - 150"), ("end_frame", "c * 100 + 80", "CASE k % 2 WHEN 0 THEN c * 100 - 20 ELSE c * 100 + 900 END"),
                     ("anchor_phases", "LIST('execution', 'preparation', 'fixation')", "LIST('warp')"), ("anchor_frames", "LIST(c * 100 + 40, c * 100 + 10, c * 100 + 70)", "LIST(c * 100 + 5, c * 100 + 30, c * 100 + 95)"), ("confidence", "CAST(0.5 AS DOUBLE)", "CAST(1.5 AS DOUBLE)"),
                     ("label_status", "'confirmed'", "'unsure'")]),
    },
    ("1 + o_custkey % 50 AS spec_k", "1 + o_orderkey % 4 AS n"),
)
LINE_VALUES = [
    *values(None, schema_version="2", timeline_id="identifier", status="draft|complete", label_source="manual|automatic|manual_reviewed_automatic", frame_index_space="sample_index", frame_count="positive", fps="positive", session_id="identifier", run_id="identifier", pose_file="text",
            pose_file_sha256="digest", recording_scope="complete_performance|partial_sequence", observed_movement_ids="texts", missing_movement_ids="texts"),
    *values("segments", confidence="probability", label_status="confirmed|provisional|ambiguous"),
]


def line_checks() -> list[C.Check]:
    ids = lambda: F.transform("segments", lambda s: s["movement_id"])
    frame = lambda e, name: (e[name] < 0) | (e[name] >= F.col("frame_count"))
    movement = lambda e: F.get(F.filter("spec_movements", lambda m: m["movement_id"] == e["movement_id"]), F.lit(0))
    whole = lambda: F.col("recording_scope") == "complete_performance"
    both = lambda: F.concat("observed_movement_ids", "missing_movement_ids")

    def anchors_in_order(e, i):
        known = F.filter(movement(e)["phases"], lambda p: F.array_contains(e["anchor_phases"], p))
        at = F.transform(known, lambda p: F.get(e["anchor_frames"], (F.array_position(e["anchor_phases"], p) - 1).cast("int")))
        return F.exists(F.sequence(F.lit(0), F.greatest(F.size(at) - 1, F.lit(0))), lambda n: F.get(at, n) < F.when(n > 0, F.get(at, n - 1)).otherwise(e["start_frame"]))

    def known_frames(e):
        return F.filter(F.arrays_zip(e["anchor_phases"].alias("p"), e["anchor_frames"].alias("f")), lambda z: F.array_contains(movement(e)["phases"], z["p"]))

    complete = lambda: (
        (F.col("spec_status") == "active") & F.col("pose_file_sha256").isNotNull() & (F.size("segments") == F.size("spec_movements")) & whole()
        & F.forall("segments", lambda s: s["label_status"] == "confirmed") & F.forall("segments", lambda s: F.size(s["anchor_phases"]) > 0)
    )
    return [
        *compiled(LINE_VALUES),
        C.Check("spec:not_bound", lambda: ~F.coalesce((F.col("poomsae_id") == F.col("spec_id")) & (F.col("poomsae_version") == F.col("spec_version")), F.lit(False))),
        C.out_of_sequence("sequence_index:not_contiguous", "segments", "sequence_index"),
        C.Check("movement_id:unknown", lambda e, i: movement(e).isNull(), "segments"), C.Check("movement_id:order", lambda e, i: movement(e)["sequence_index"] != i + 1, "segments"),
        C.Check("start_frame:outside", lambda e, i: frame(e, "start_frame"), "segments"), C.Check("end_frame:outside", lambda e, i: frame(e, "end_frame"), "segments"),
        C.Check("frames:inverted", lambda e, i: e["start_frame"] > e["end_frame"], "segments"), C.sweep("segments:overlap", "segments", "start_frame", "end_frame"),
        C.Check("anchors:unknown_phase", lambda e, i: F.exists(e["anchor_phases"], lambda p: ~F.coalesce(F.array_contains(movement(e)["phases"], p), F.lit(False))), "segments"),
        C.Check("anchors:outside", lambda e, i: F.exists(known_frames(e), lambda z: (z["f"] < e["start_frame"]) | (z["f"] > e["end_frame"])), "segments"), C.Check("anchors:phase_order", anchors_in_order, "segments"),
        C.Check("observed:not_the_segments", lambda: F.col("observed_movement_ids") != ids()), C.Check("coverage:repeated", lambda: F.size(F.array_distinct(both())) < F.size(both())),
        C.no_partition("coverage:no_partition", lambda: [F.col("observed_movement_ids"), F.col("missing_movement_ids")], lambda: F.transform("spec_movements", lambda m: m["movement_id"])),
        C.if_then("complete_performance:not_whole", whole, lambda: (F.size("missing_movement_ids") == 0) & F.col("source_end_reason").isNull()),
        C.if_then("partial_sequence:nothing_missing", lambda: F.col("recording_scope") == "partial_sequence", lambda: (F.size("observed_movement_ids") > 0) & (F.size("missing_movement_ids") > 0)),
        C.if_then("partial_sequence:no_reason", lambda: F.col("recording_scope") == "partial_sequence", lambda: ~C.no_text(F.col("source_end_reason"))),
        C.if_then("complete:not_confirmed", lambda: F.col("status") == "complete", complete),
    ]


_MET = """line_met AS (SELECT l.*, s.poomsae_id AS spec_id, s.version AS spec_version, s.status AS spec_status FROM line l LEFT JOIN spec s ON s.k = l.spec_k),
line_segments_met AS (SELECT g.*, l.frame_count, m.k AS mk, m.sequence_index AS m_index, m.phases FROM line_segments g JOIN line l ON l.k = g.k LEFT JOIN (SELECT * FROM spec_movements QUALIFY row_number() OVER (PARTITION BY k, movement_id ORDER BY c) = 1) m ON m.k = l.spec_k AND m.movement_id = g.movement_id),
line_spec AS (SELECT l.k, coalesce(list(m.movement_id ORDER BY m.c) FILTER (WHERE m.c IS NOT NULL), []) AS ids FROM line l LEFT JOIN spec_movements m ON m.k = l.spec_k GROUP BY l.k),
line_ids AS (SELECT k, list(movement_id ORDER BY c) AS ids, bool_and(label_status = 'confirmed') AS sure FROM line_segments GROUP BY k),
line_anchors AS (SELECT k, c, start_frame, end_frame, f, list_position(phases, p) AS place FROM (SELECT k, c, start_frame, end_frame, phases, unnest(anchor_phases) AS p, unnest(anchor_frames) AS f FROM line_segments_met) WHERE list_contains(phases, p)),
line_steps AS (SELECT *, lag(f, 1, start_frame) OVER (PARTITION BY k, c ORDER BY place) AS before FROM line_anchors)"""
_SEG = "SELECT DISTINCT k, 'segments[' || c || ']', '{}' FROM {} WHERE {}"
LINE_SQL = [
    "SELECT k, '', 'spec:not_bound' FROM line_met WHERE NOT coalesce(poomsae_id = spec_id AND poomsae_version = spec_version, FALSE)",
    _SEG.format("sequence_index:not_contiguous", "line_segments", "sequence_index <> c"), _SEG.format("movement_id:unknown", "line_segments_met", "mk IS NULL"), _SEG.format("movement_id:order", "line_segments_met", "m_index <> c"),
    _SEG.format("start_frame:outside", "line_segments_met", "start_frame < 0 OR start_frame >= frame_count"), _SEG.format("end_frame:outside", "line_segments_met", "end_frame < 0 OR end_frame >= frame_count"), _SEG.format("frames:inverted", "line_segments", "start_frame > end_frame"),
    "SELECT k, 'segments[' || c || ']', 'segments:overlap' FROM (SELECT *, lag(end_frame, 1, -1) OVER (PARTITION BY k ORDER BY c) AS before FROM line_segments) WHERE start_frame <= before",
    _SEG.format("anchors:unknown_phase", "(SELECT k, c, phases, unnest(anchor_phases) AS p FROM line_segments_met)", "NOT coalesce(list_contains(phases, p), FALSE)"),
    _SEG.format("anchors:outside", "line_anchors", "f < start_frame OR f > end_frame"), _SEG.format("anchors:phase_order", "line_steps", "f < before"),
    "SELECT l.k, '', 'observed:not_the_segments' FROM line l JOIN line_ids i ON i.k = l.k WHERE observed_movement_ids <> ids",
    "SELECT k, '', 'coverage:repeated' FROM line WHERE len(list_distinct(observed_movement_ids || missing_movement_ids)) < len(observed_movement_ids) + len(missing_movement_ids)",
    "SELECT l.k, '', 'coverage:no_partition' FROM line l JOIN line_spec s ON s.k = l.k WHERE observed_movement_ids || missing_movement_ids <> ids",
    "SELECT k, '', 'complete_performance:not_whole' FROM line WHERE recording_scope = 'complete_performance' AND (len(missing_movement_ids) > 0 OR source_end_reason IS NOT NULL)",
    "SELECT k, '', 'partial_sequence:nothing_missing' FROM line WHERE recording_scope = 'partial_sequence' AND (len(observed_movement_ids) = 0 OR len(missing_movement_ids) = 0)",
    "SELECT k, '', 'partial_sequence:no_reason' FROM line WHERE recording_scope = 'partial_sequence' AND coalesce(trim(source_end_reason), '') = ''",
    "SELECT l.k, '', 'complete:not_confirmed' FROM line_met l JOIN line_ids i ON i.k = l.k JOIN line_spec s ON s.k = l.k WHERE status = 'complete' AND NOT coalesce(spec_status = 'active' AND pose_file_sha256 IS NOT NULL AND len(i.ids) = len(s.ids) AND recording_scope = 'complete_performance' AND sure, FALSE)",
]


@query("i11_timeline_checks", f"WITH {SPECS.sql()}, {TIMELINES.sql()}, {_MET} {oracle(TIMELINES, LINE_VALUES, LINE_SQL)}")
def i11(spark, sf):
    """Timelines against their specification, which one join on its key brings into the timeline's row."""
    specs = SPECS.frame(spark, sf).select(F.col("k").alias("spec_k"), F.col("poomsae_id").alias("spec_id"), F.col("version").alias("spec_version"), F.col("status").alias("spec_status"), F.col("movements").alias("spec_movements"))
    lines = TIMELINES.frame(spark, sf).join(specs, "spec_k", "left").withColumn("spec_movements", F.coalesce("spec_movements", F.slice("spec_movements", 1, 0)))
    return C.violations(lines, ["k"], line_checks())


# ---------------------------------------------------------------- I12 profiles

ENGINEERING = Documents(
    "eng", "customer", "c_custkey",
    [("schema_version", "1", "0"), ("profile_id", "concat('e', k)", "'e 1'"), ("version", "'1'", "''"), ("status", "'provisional_engineering'", "'final'"), ("rule_pack_id", "'pack_1'", "''"), ("poomsae_id", "'spec_1'", "'spec 1'"), ("recording_scope", "'partial_sequence'", "'whole'"),
     ("movement_ids", "LIST('M1', 'M2')", EMPTY), ("reference_accuracy_score", "CAST(4 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("threshold_origin", "'engineering_hypothesis_not_official_rule'", "'official'"), ("rule_semantics_refs", "LIST('a')", "LIST('a', '')"), ("technique_semantics", "'text'", "''"),
     ("disclaimer", "'text'", "' '"), ("min_body17_valid_ratio", "CAST(0.8 AS DOUBLE)", "CAST(1.2 AS DOUBLE)"), ("min_used_cameras", "CAST(2 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("max_median_reprojection_error_px", "CAST(8 AS DOUBLE)", "CAST(-8 AS DOUBLE)"),
     ("min_label_confidence", "CAST(0.5 AS DOUBLE)", "CAST(NULL AS DOUBLE)"), ("candidate_kind", "'minor'", "'major'"), ("deduplicate_by", "'movement_family_phase'", "'movement'"), ("automatic_major_detection", "'false'", "'true'"), ("score_field", "'partial_engineering_trial_score'", "'score'")],
    {
        "criteria": ("k % 4", [("criterion_id", "concat('C', c)", "CASE k % 2 WHEN 0 THEN 'C1' ELSE 'C 1' END"), ("family", "'balance'", "'b c'"), ("phase_id", "'fixation'", "''"), ("metric", "'lean'", "' '"), ("deduction_kind", "'minor'", "'major'"), ("rationale", "'text'", "''"),
                     ("selector_field", "CASE c WHEN 1 THEN 'all' WHEN 2 THEN 'stance' ELSE 'technique' END", "'side'"), ("selector_values", f"CASE c WHEN 1 THEN {EMPTY} ELSE LIST('x') END", f"CASE c WHEN 1 THEN LIST('x', ' ') ELSE {EMPTY} END"),
                     ("lower", "CAST(10 AS DOUBLE)", "CASE k % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(90 AS DOUBLE) END"), ("upper", "CAST(30 AS DOUBLE)", "CAST(0 AS DOUBLE)")]),
    },
)
ENGINEERING_VALUES = [
    *values(None, schema_version="1", profile_id="identifier", version="text", status="provisional_engineering", rule_pack_id="identifier", poomsae_id="identifier", recording_scope="partial_sequence", movement_ids="some_texts", reference_accuracy_score="positive",
            threshold_origin="engineering_hypothesis_not_official_rule", rule_semantics_refs="some_texts", technique_semantics="text", disclaimer="text", min_body17_valid_ratio="probability", min_used_cameras="positive", max_median_reprojection_error_px="positive",
            min_label_confidence="probability", candidate_kind="minor", deduplicate_by="movement_family_phase", automatic_major_detection="false", score_field="partial_engineering_trial_score"),
    *values("criteria", criterion_id="identifier", family="identifier", phase_id="identifier", metric="identifier", deduction_kind="minor", rationale="text", selector_field="all|stance|technique", selector_values="texts", lower="nonnegative", upper="positive"),
]


def engineering_checks() -> list[C.Check]:
    return [
        *compiled(ENGINEERING_VALUES), C.empty("criteria:empty", "criteria"), C.repeated("criterion_id:repeated", "criteria", "criterion_id"),
        C.Check("selector:all_with_values", lambda e, i: (e["selector_field"] == "all") & (F.size(e["selector_values"]) > 0), "criteria"),
        C.Check("selector:no_values", lambda e, i: (e["selector_field"] != "all") & (F.size(e["selector_values"]) == 0), "criteria"),
        C.Check("acceptable_range:inverted", lambda e, i: e["lower"] > e["upper"], "criteria"),
    ]


ENGINEERING_SQL = [
    found("eng", None, "criteria:empty", "k % 4 = 0"), sql_repeated("eng", "criteria", "criterion_id:repeated", "criterion_id"), found("eng", "criteria", "selector:all_with_values", "selector_field = 'all' AND len(selector_values) > 0"),
    found("eng", "criteria", "selector:no_values", "selector_field <> 'all' AND len(selector_values) = 0"), found("eng", "criteria", "acceptable_range:inverted", "lower > upper"),
]

PAIRS = ("face_eye_separation", "hand_palm_length", "foot_length")
_LIMIT = "CAST(CASE c " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(THRESHOLDS.values(), 1)) + " END AS DOUBLE)"
DIAGNOSTIC = Documents(
    "diag", "customer", "c_custkey",
    [("schema_version", "1", "2"), ("status", "'diagnostic_only_unvalidated'", "'validated'"), ("profile_id", "'d1'", "''"), ("version", "'2'", "' '"), ("poomsae_id", "'spec_1'", "''"), ("disclaimer", "'text'", "''"), ("required_keypoint_count", "133", "17"),
     ("numeric_score_enabled", "'false'", "'true'"), ("insufficient_coverage_blocks_score", "'true'", "'false'"), ("minimum_metric_coverage", "CAST(0.9 AS DOUBLE)", "CAST(1.9 AS DOUBLE)"), ("min_used_cameras", "CAST(2 AS DOUBLE)", "CAST(0 AS DOUBLE)"),
     ("max_reprojection_error_px", "CAST(8 AS DOUBLE)", "CAST(NULL AS DOUBLE)"), ("min_segment_group_valid_ratio", "CAST(0.75 AS DOUBLE)", "CAST(-0.1 AS DOUBLE)"), ("anchor_window_radius_frames", "k % 4", "-1"), ("min_anchor_window_valid_samples", "3", "0"),
     *[(f"{p}_min", "CAST(0.05 AS DOUBLE)", "CASE k % 2 WHEN 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END") for p in PAIRS], *[(f"{p}_max", "CAST(0.5 AS DOUBLE)", "CAST(0 AS DOUBLE)") for p in PAIRS]],
    {"thresholds": (str(len(THRESHOLDS)), [("name", kinds_of(*THRESHOLDS), "'other'"), ("value", _LIMIT, "CASE k % 2 WHEN 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(500 AS DOUBLE) END")])},
)
DIAGNOSTIC_VALUES = [
    *values(None, schema_version="1", status="diagnostic_only_unvalidated", profile_id="text", version="text", poomsae_id="text", disclaimer="text", required_keypoint_count="133", numeric_score_enabled="false", insufficient_coverage_blocks_score="true",
            minimum_metric_coverage="probability", min_used_cameras="positive", max_reprojection_error_px="positive", min_segment_group_valid_ratio="probability", anchor_window_radius_frames="nonnegative", min_anchor_window_valid_samples="positive",
            **{f"{p}_{e}": "positive" for p in PAIRS for e in ("min", "max")}),
    *values("thresholds", value="nonnegative"),
]


def diagnostic_checks() -> list[C.Check]:
    limit = lambda name: F.get(F.filter("thresholds", lambda t: t["name"] == name), F.lit(0))["value"]
    return [
        *compiled(DIAGNOSTIC_VALUES), C.Check("window:too_few_frames", lambda: F.col("min_anchor_window_valid_samples") > 2 * F.col("anchor_window_radius_frames") + 1),
        *[C.Check(f"{p}:inverted", lambda p=p: F.col(f"{p}_min") >= F.col(f"{p}_max")) for p in PAIRS], C.wrong_members("thresholds:members", "thresholds", "name", list(THRESHOLDS)),
        *[C.Check(f"{p}:inverted", lambda p=p: limit(f"{p}_min") > limit(f"{p}_max")) for p in RANGES],
    ]


DIAGNOSTIC_SQL = [
    found("diag", None, "window:too_few_frames", "min_anchor_window_valid_samples > 2 * anchor_window_radius_frames + 1"), *[found("diag", None, f"{p}:inverted", f"{p}_min >= {p}_max") for p in PAIRS],
    sql_members("diag", "thresholds", "thresholds:members", "name", list(THRESHOLDS)),
    *[f"SELECT a.k, '', '{p}:inverted' FROM diag_thresholds a JOIN diag_thresholds b ON b.k = a.k AND a.name = '{p}_min' AND b.name = '{p}_max' WHERE a.value > b.value" for p in RANGES],
]

ACCURACY = Documents(
    "acc", "customer", "c_custkey",
    [("schema_version", "1", "2"), ("status", "'provisional_historical_geometry'", "'current'"), ("profile_id", "'a1'", "''"), ("version", "'1'", "' '"), ("poomsae_id", "'spec_1'", "''"), ("disclaimer", "'text'", "''"), ("minor_points", "CAST(0.1 AS DOUBLE)", "CAST(0 AS DOUBLE)"),
     ("major_points", "CAST(0.3 AS DOUBLE)", "CAST(-1 AS DOUBLE)"), ("restart_points", "CAST(0.6 AS DOUBLE)", "CAST(NULL AS DOUBLE)"), ("minimum_observation_confidence", "CAST(0.9 AS DOUBLE)", "CAST(2 AS DOUBLE)"), ("boundary_policy", "'require_95pct_interval_wholly_outside'", "'mean'"),
     ("numeric_geometry_can_create_major", "'false'", "'true'"), ("partial_timeline_score_enabled", "'false'", "'true'")],
    {
        "numeric": ("k % 5", [("rule_id", "concat('N', c)", "CASE k % 2 WHEN 0 THEN 'N1' ELSE '' END"), ("error_unit", "'stance'", "''"), ("metric_id", "'knee'", "''"), ("unit", "'deg'", "' '"), ("description", "'text'", "''"), ("stances", "LIST('walking')", f"CASE k % 2 WHEN 0 THEN LIST(' ') ELSE {EMPTY} END"), ("technique_ids", f"CASE k % 4 WHEN 0 THEN LIST('') ELSE {EMPTY} END", None),
                    ("operator", "CASE c % 2 WHEN 0 THEN 'max' ELSE 'range' END", "'min'"), ("limits", "CASE c % 2 WHEN 0 THEN LIST(CAST(30 AS DOUBLE)) ELSE LIST(CAST(10 AS DOUBLE), CAST(20 AS DOUBLE)) END", "LIST(CAST(20 AS DOUBLE), CAST(10 AS DOUBLE))"),
                    ("uncertainty_floor", "CAST(1 AS DOUBLE)", "CAST(-1 AS DOUBLE)"), ("boundary_guard", "CAST(0.5 AS DOUBLE)", "CAST(NULL AS DOUBLE)"), ("deduction_kind", "'minor'", "'major'"), ("source_id", "'S1'", "''"), ("content_sha256", "SHA(c)", "''"),
                    ("authority_status", "'historical_official_not_current_attachment'", "'current'"), ("pages", "LIST('1')", EMPTY)]),
        "categorical": ("k % 3", [("rule_id", "concat('K', c)", "CASE k % 2 WHEN 0 THEN 'K1' ELSE ' ' END"), ("event_kind", "'fall'", "''"), ("error_unit", "'body'", "''"), ("source_ref", "'S1#1'", "' '"), ("deduction_kind", "'major'", "'minor'"), ("confirmation_methods", "LIST('review')", EMPTY)]),
    },
)
ACCURACY_VALUES = [
    *values(None, schema_version="1", status="provisional_historical_geometry", profile_id="text", version="text", poomsae_id="text", disclaimer="text", minor_points="positive", major_points="positive", restart_points="positive", minimum_observation_confidence="probability",
            boundary_policy="require_95pct_interval_wholly_outside", numeric_geometry_can_create_major="false", partial_timeline_score_enabled="false"),
    *values("numeric", rule_id="text", error_unit="text", metric_id="text", unit="text", description="text", stances="texts", technique_ids="texts", operator="max|range", uncertainty_floor="nonnegative", boundary_guard="nonnegative", deduction_kind="minor", source_id="text",
            content_sha256="text", authority_status="historical_official_not_current_attachment", pages="some_texts"),
    *values("categorical", rule_id="text", event_kind="text", error_unit="text", source_ref="text", deduction_kind="major|restart", confirmation_methods="some_texts"),
]


def accuracy_checks() -> list[C.Check]:
    return [
        *compiled(ACCURACY_VALUES), C.empty("numeric_rules:empty", "numeric"), C.empty("categorical_rules:empty", "categorical"), C.repeated("rule_id:repeated", "numeric", "rule_id"), C.repeated("rule_id:repeated", "categorical", "rule_id"),
        C.Check("rule:unconstrained", lambda e, i: (F.size(e["stances"]) == 0) & (F.size(e["technique_ids"]) == 0), "numeric"),
        C.Check("limits:number", lambda e, i: F.size(e["limits"]) != F.when(e["operator"] == "max", 1).otherwise(2), "numeric"), C.Check("limits:not_finite", lambda e, i: F.exists(e["limits"], C.not_finite), "numeric"),
        C.Check("limits:inverted", lambda e, i: (e["operator"] == "range") & (F.get(e["limits"], F.lit(0)) >= F.get(e["limits"], F.lit(1))), "numeric"),
    ]


ACCURACY_SQL = [
    found("acc", None, "numeric_rules:empty", "k % 5 = 0"), found("acc", None, "categorical_rules:empty", "k % 3 = 0"), sql_repeated("acc", "numeric", "rule_id:repeated", "rule_id"), sql_repeated("acc", "categorical", "rule_id:repeated", "rule_id"),
    found("acc", "numeric", "rule:unconstrained", "len(stances) = 0 AND len(technique_ids) = 0"), found("acc", "numeric", "limits:number", "len(limits) <> CASE WHEN operator = 'max' THEN 1 ELSE 2 END"),
    found("acc", "numeric", "limits:inverted", "operator = 'range' AND limits[1] >= limits[2]"),
]
PROFILES = (("engineering", ENGINEERING, ENGINEERING_VALUES, ENGINEERING_SQL, engineering_checks), ("diagnostic", DIAGNOSTIC, DIAGNOSTIC_VALUES, DIAGNOSTIC_SQL, diagnostic_checks), ("accuracy", ACCURACY, ACCURACY_VALUES, ACCURACY_SQL, accuracy_checks))


@query(
    "i12_profile_checks",
    "WITH " + ", ".join(d.sql() for _, d, *_ in PROFILES) + " " + " UNION ALL ".join(f"SELECT '{name}' AS contract, k, item, violation FROM ({oracle(d, v, s)})" for name, d, v, s, _ in PROFILES),
)
def i12(spark, sf):
    """Engineering, diagnostic and accuracy profiles: allowed values, gates, ordered limits, exact threshold names, unique rules."""
    parts = [C.violations(d.frame(spark, sf).withColumn("contract", F.lit(name)), ["contract", "k"], checks()) for name, d, _, _, checks in PROFILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
