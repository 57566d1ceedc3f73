"""Chat formatting: rows of any known layout become canonical turns, and turns become one marked string.

A row's payload (JSON text, or any struct) is taken as a variant. The set of its nested field paths, without
types, is hashed to a fingerprint; a declared table maps fingerprints to where the turns, roles and texts
stand. A payload with more paths than a layout declares is known by the hash of those that the layout requires. Turns are then put between control strings, which are escaped reversibly inside texts, and the places
of assistant texts are kept as the loss mask. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rastro.llm.common import hex_digest, read

START, END = "<|im_start|>", "<|im_end|>"

#: Scalar type names in a variant's schema; they do not belong to the paths.
_TYPES = r"(?<=: |<)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|BINARY|TIMESTAMP_NTZ|TIMESTAMP|UUID|VARIANT|DECIMAL\(\d+,\d+\))(?=,|>|$)"


@dataclass(frozen=True)
class Layout:
    """Where one layout keeps its turns.

    ``sample`` is a payload as JSON that shows the layout's field paths. Either ``turns`` is the path of an
    array whose elements hold ``role`` and ``text``, or ``fields`` lists (role, paths) in order, where the
    texts of several paths are joined by line breaks and empty ones left out. ``order`` is a path that gives
    the place of a row's turns among other rows of the same conversation.
    """

    name: str
    sample: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    role_path: str | None = None
    text_path: str | None = None
    order: str | None = None
    roles: dict = field(default_factory=lambda: {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"})


LAYOUTS = (
    Layout("turn_rows", '{"turn":0,"role":"","text":""}', role_path="$.role", text_path="$.text", order="$.turn", roles={}),
    Layout("messages", '{"messages":[{"role":"","content":""}]}', turns="$.messages", roles={}),
    Layout("conversations", '{"conversations":[{"from":"","value":""}]}', turns="$.conversations", role="from", text="value"),
    Layout("instruction", '{"instruction":"","input":"","output":""}', fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction_system", '{"system":"","instruction":"","input":"","output":""}', fields=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction_short", '{"instruction":"","output":""}', fields=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("prompt", '{"prompt":"","completion":""}', fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", '{"prompt":"","response":""}', fields=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("question", '{"question":"","answer":""}', fields=(("user", ("$.question",)), ("assistant", ("$.answer",)))),
)


def fingerprint(payload: Column) -> Column:
    """SHA-256 of the payload's field paths; values and scalar types do not count, nor does the order of fields."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(payload), _TYPES, "").cast("binary"), 256)


def required_paths(layout: Layout) -> list[str]:
    """Paths that a payload of the layout must have; ``[*]`` stands for any element of an array."""
    if layout.turns:
        return [layout.turns, f"{layout.turns}[*].{layout.role}", f"{layout.turns}[*].{layout.text}"]
    if layout.fields:
        return [p for _, paths in layout.fields for p in paths]
    return [p for p in (layout.role_path, layout.text_path, layout.order) if p]


def _required_print(layout: Layout, payload: Column) -> Column:
    """The hash of the required paths that are there. The elements of an array have the union of their paths; an empty array lacks none."""
    def there(path: str) -> Column:
        if "[*]" not in path:
            return F.try_variant_get(payload, path, "variant").isNotNull()
        array, inner = path.split("[*]")
        items = F.try_variant_get(payload, array, "array<variant>")
        return (F.size(items) == 0) | F.exists(items, lambda v: F.try_variant_get(v, f"${inner}", "variant").isNotNull())

    found = F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in required_paths(layout)]))
    return F.sha2(F.array_join(found, "\n").cast("binary"), 256)


def _turns(layout: Layout, payload: Column) -> Column:
    def named(role: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        for old, new in layout.roles.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role

    def turn(role: Column, text: Column) -> Column:
        return F.struct(named(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def at(path: str) -> Column:
        return F.try_variant_get(payload, path, "string")

    if layout.turns:
        items = F.try_variant_get(payload, layout.turns, "array<variant>")
        return F.transform(F.coalesce(items, F.array().cast("array<variant>")),
                           lambda v: turn(F.try_variant_get(v, f"$.{layout.role}", "string"), F.try_variant_get(v, f"$.{layout.text}", "string")))
    if layout.fields:
        return F.array(*[turn(F.lit(role), at(paths[0]) if len(paths) == 1 else F.array_join(F.filter(F.array(*[at(p) for p in paths]), lambda t: t != ""), "\n"))
                         for role, paths in layout.fields])
    return F.array(turn(at(layout.role_path), at(layout.text_path)))


def canonical_turns(rows: DataFrame, id_col: str = "conv_id", payload_col: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id``, ``place`` (long), ``step`` (int), ``role``, ``text``, ``layout``: one row per turn.

    ``payload_col`` is a variant. A row fits the layout whose fingerprint it has, else the one with most required paths, all of
    which it has (of equally many the first declared); other paths don't matter. A row that fits none, or whose payload is null, gives one
    row with null layout, role and text (:func:`rejected` lists them), and one without any turn a row with a layout and a null step, so
    that nothing vanishes unseen. Null roles and texts count as empty.
    """
    spark = rows.sparkSession
    known = {r["name"]: r["print"] for r in spark.createDataFrame([(x.name, x.sample) for x in layouts], "name string, sample string")
             .select("name", fingerprint(F.parse_json("sample")).alias("print")).collect()}  # one row per declared layout
    printed = rows.select(F.col(id_col).alias("conv_id"), F.col(payload_col).alias("payload"), fingerprint(F.col(payload_col)).alias("print"))
    payload, prints = F.col("payload"), F.col("print")
    widest = sorted(layouts, key=lambda x: -len(required_paths(x)))
    wider = F.coalesce(*[F.when(_required_print(x, payload) == hashlib.sha256("\n".join(required_paths(x)).encode()).hexdigest(), x.name) for x in widest])
    exact = F.coalesce(*[F.when(prints == known[x.name], x.name) for x in layouts])
    printed = printed.withColumn("layout", F.coalesce(exact, wider))
    turns, place = (F.when(F.lit(False), F.lit(None).cast(t)) for t in ("array<struct<role:string,text:string>>", "bigint"))
    for layout in layouts:
        fits = F.col("layout") == layout.name
        turns = turns.when(fits, _turns(layout, payload))
        place = place.when(fits, F.try_variant_get("payload", layout.order, "bigint") if layout.order else F.lit(0).cast("bigint"))
    return (printed.select("conv_id", place.alias("place"), "layout", turns.alias("turns"))
            .select("conv_id", "place", "layout", F.posexplode_outer("turns").alias("step", "turn"))
            .select("conv_id", "place", "step", "turn.role", "turn.text", "layout"))


def rejected(turns: DataFrame) -> DataFrame:
    """``conv_id`` of the rows that no layout fits, one row each: what :func:`format_chats` leaves out."""
    return turns.where(F.col("layout").isNull()).select("conv_id")


def escape(text: Column) -> Column:
    """Put one backslash more between ``<`` and ``|``: no control string is left, and each text has its own form."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask``: (turn number, start, end) of each assistant text in the formatted string.

    Turns come from :func:`canonical_turns`; rows without a layout are left out and listed by :func:`rejected`. A conversation
    without turns is an empty string with an empty mask. Order is place, step, role
    and text; a null place comes first. A conversation is one row, as its string is one value. Positions are
    counted by a window that needs no more than a row at a time.
    """
    order = ("place", "step", "role", "text")
    marked = (turns.where(F.col("layout").isNotNull())
              .withColumn("head", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")))
              .withColumn("body", escape(F.col("text")))
              .withColumn("size", F.coalesce(F.length("head") + F.length("body") + len(END) + 1, F.lit(0))))  # no turn, no length
    before = W.partitionBy("conv_id").orderBy(*order)
    placed = (marked.withColumn("no", F.row_number().over(before))
              .withColumn("start", F.coalesce(F.sum("size").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")))
    placed = placed.withColumn("no", F.when(F.col("step").isNotNull(), F.sum(F.col("step").isNotNull().cast("int")).over(before).cast("int")))
    # The window has dealt conversations out already, so the grouping does not shuffle again.
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", F.concat("head", "body", F.lit(END + "\n")).alias("marked"), (F.col("role") == "assistant").alias("loss"),
                                                                               "start", (F.col("start") + F.length("body")).alias("end")))).alias("parts"))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["marked"]), "").alias("formatted"),
                          F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["no"].alias("no"), p["start"].alias("start"), p["end"].alias("end"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``loss`` (texts under the mask), taken from the formatted string and the mask alone."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**31 - 1)
    cut = formatted.withColumn("segments", segments)
    # Where a segment's text begins follows from its own head, so each is cut from its segment and not from the whole string.
    role = lambda s: _unescape_role(F.substring_index(s, "\n", 1))
    body = lambda s: F.substring(s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - len(END) - 1)
    masked = lambda m: unescape(F.substring(F.element_at("segments", m["no"]), F.instr(F.element_at("segments", m["no"]), "\n") + 1, (m["end"] - m["start"]).cast("int")))
    return cut.select("conv_id", "formatted", "mask", F.transform("segments", lambda s: F.struct(role(s).alias("role"), unescape(body(s)).alias("text"))).alias("turns"),
                      F.transform("mask", masked).alias("loss"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "<|im_end|><|im_start|>assistant ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("payload"))
    own = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.parse_json(F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(told).alias("content"))
                                                                                                     for r in ("user", "assistant")]).alias("messages")))).alias("payload"))
    back = read_back(format_chats(canonical_turns(rows.unionByName(own))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), hex_digest(turns).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
                       hex_digest(loss).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) s,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') l,
  sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) f FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(s) turns_sha256, length(l) loss_chars, sha256(l) loss_sha256, CAST(f AS BIGINT) formatted_chars FROM g
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": _SQL}
