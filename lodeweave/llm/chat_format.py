r"""Chat records of any layout into one template, with a loss mask, and back.

Records are JSON. The nested field paths of each are hashed, and the hash picks a declarative mapping that says where its
turns stand: a prompt with its answer, an instruction with its input, or a list of messages, under the names that the source
uses. The template marks every turn by its role and escapes its own control strings inside texts and role names: each of
them, and each backslash, gets a backslash behind its first character, so that no text can open or close a turn and the
text comes back as it was. The loss mask lists the places of the assistant's texts. Long conversations are written in parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.materialize import materialize

#: A role's control strings; other roles are named between those of ``OTHER``.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
CONTROLS = [mark for pair in MARKS.values() for mark in pair] + list(OTHER)
#: So many turns of a conversation stand in one part at most.
TURNS_PER_PART = 256
_TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand.

    ``example`` has every field path of the layout; the fields of ``optional`` may be missing, in any combination. Either
    ``turns`` names role and fields in order (several fields of a turn are joined by an empty line, missing ones left out),
    or the turns are the elements of ``list``, with their role and text in the fields ``role`` and ``text``; ``roles`` says
    what other names of roles mean.
    """

    name: str
    example: str
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    list: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = [
    Layout("prompt", '{"system": "", "prompt": "", "response": ""}', ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", '{"instruction": "", "input": "", "output": ""}', ("input",), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', list="messages", role="role", text="content"),
    Layout("from_value", '{"conversations": [{"from": "", "value": ""}]}', list="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
]


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, in a canonical order and without types, so null and text are alike."""
    kinds = r"(?<=: |ARRAY<|^)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), kinds, "_")


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a variant; null for one that could not be read."""
    return F.when(record.isNotNull(), F.xxhash64(field_paths(record)))


def _fingerprints(layout: Layout) -> list[Column]:
    """Those of all records of a layout: every choice of its optional fields."""
    import json

    examples = [json.loads(layout.example)]
    for name in layout.optional:
        examples += [{k: v for k, v in e.items() if k != name} for e in examples]
    if layout.list:
        examples.append({layout.list: []})
    return [fingerprint(F.parse_json(F.lit(json.dumps(e)))) for e in examples]


def _turns(record: Column, layout: Layout) -> Column:
    if layout.list:
        rows = F.try_variant_get(record, f"$.{layout.list}", f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")

        def turn(row: Column) -> Column:
            role = row[layout.role]
            for other, meant in layout.roles.items():
                role = F.when(row[layout.role] == other, meant).otherwise(role)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(row[layout.text], F.lit("")).alias("text"))

        return F.transform(rows, turn).cast(_TURNS)
    given = F.map_keys(F.try_variant_get(record, "$", "map<string, variant>"))
    found = []
    for role, names in layout.turns:
        parts = [F.when(F.array_contains(given, name), F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))) for name in names]
        some = F.array_contains(given, names[0])
        found.append(F.when(some, F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text"))))
    return F.array_compact(F.array(*found)).cast(_TURNS)


def canonical_turns(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``conv_id, layout, turns`` of ``conv_id, record`` (JSON): ``turns`` is an array of ``role, text``.

    A record of unknown paths, or that is no JSON or null, stays, with neither layout nor turns. Null texts and roles are
    empty; repeated rows are converted each by itself; other columns are left out.
    """
    read = records.select("conv_id", F.try_parse_json("record").alias("v"))
    read = read.withColumn("paths", fingerprint(F.col("v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for layout in layouts:
        own = F.col("paths").isin(_fingerprints(layout))
        name, turns = F.when(own, layout.name).otherwise(name), F.when(own, _turns(F.col("v"), layout)).otherwise(turns)
    return read.select("conv_id", name.alias("layout"), turns.alias("turns"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def escape(text: Column) -> Column:
    starts = "|".join(_quoted(c[1:]) for c in CONTROLS)
    return F.regexp_replace(text, rf"\\|[<\[](?={starts})", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _around(role: Column) -> tuple[Column, Column]:
    before, after = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (first, last) in MARKS.items():
        before, after = F.when(role == name, first).otherwise(before), F.when(role == name, last).otherwise(after)
    return before, after


def format_turns(conversations: DataFrame, learned: str = "assistant", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """``conv_id, part, formatted, loss`` of ``conv_id, turns``; ``loss`` is an array of ``start, length`` in code points of ``formatted``.

    The mask covers the (escaped) texts of the role ``learned`` and nothing else. A conversation without turns has one
    empty part.
    """
    size = F.size(F.coalesce("turns", F.array().cast(_TURNS)))
    parts = F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / turns_per_part).cast("int"))
    rows = conversations.select("conv_id", F.coalesce("turns", F.array().cast(_TURNS)).alias("turns"), F.explode(parts).alias("part"))

    def shown(turn: Column) -> Column:
        before, after = _around(turn["role"])
        return F.struct(before.alias("before"), escape(turn["text"]).alias("text"), after.alias("after"), (turn["role"] == learned).alias("learned"))

    rows = rows.select("conv_id", "part", F.transform(F.slice("turns", F.col("part") * turns_per_part + 1, F.lit(turns_per_part)), shown).alias("t"))
    length = lambda x: (F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"])).cast("long")
    rows = rows.withColumn("sizes", F.transform("t", length))
    start = lambda x, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b) + F.length(x["before"])
    spans = F.transform("t", lambda x, i: F.when(x["learned"], F.struct(start(x, i).alias("start"), F.length(x["text"]).cast("long").alias("length"))))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["before"], x["text"], x["after"])), "")
    return rows.select("conv_id", "part", text.alias("formatted"), F.array_compact(spans).alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """The turns (``role, text``) of a formatted part, as they were before."""
    pieces = [f"{_quoted(first)}.*?{_quoted(last)}" for first, last in MARKS.values()] + [f"{_quoted(OTHER[0])}.*?{_quoted(OTHER[2])}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)(?:" + "|".join(pieces) + ")"), F.lit(0))

    def turn(piece: Column) -> Column:
        names = F.split(F.substring(piece, F.lit(len(OTHER[0]) + 1), F.length(piece) - len(OTHER[0]) - len(OTHER[2])), _quoted(OTHER[1]), 2)
        role, text = unescape(names[0]), F.get(names, F.lit(1))
        for name, (first, last) in MARKS.items():
            own = F.startswith(piece, F.lit(first))
            inside = F.substring(piece, F.lit(len(first) + 1), F.length(piece) - len(first) - len(last))
            role, text = F.when(own, name).otherwise(role), F.when(own, inside).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, without escapes and with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: rows of ``conv_id, turn, role, text`` as one JSON record for each conversation, in the layout that suits it.

    A question with its answer is a prompt with a response, what begins with a system's text and has only known roles is a
    list of ``from, value``, all else a list of messages. Rows are ordered by turn, role and text, nulls first; null texts
    are empty. A conversation is one record, so its size bounds the memory of a task.
    """
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    roles = F.transform("t", lambda x: F.coalesce(x["role"], F.lit("")))
    names = {meant: other for other, meant in LAYOUTS[3].roles.items()}
    other = lambda r: F.coalesce(*[F.when(r == a, b) for a, b in names.items()], r)
    known = F.forall(roles, lambda r: r.isin(*MARKS)) & (F.get(roles, F.lit(0)) == "system")
    keep = {"ignoreNullFields": "false"}
    prompt = F.to_json(F.struct(F.get("t", F.lit(0))["text"].alias("prompt"), F.get("t", F.lit(1))["text"].alias("response")), keep)
    listed = F.to_json(F.struct(F.transform("t", lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")), keep)
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")), keep)
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    return found.select("conv_id", F.when(pair, prompt).when(known, listed).otherwise(messages).alias("record"))


#: A conversation whose texts are control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and the planted one, read back from the formatted table."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    out = materialize(format_turns(canonical_turns(records(rows.unionByName(planted)))), "formatted")
    digest = F.array_join(F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = out.select("conv_id", "part", F.size(parse_turns(F.col("formatted"))).alias("n"), digest.alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "turns", "loss", "chars"))).alias("p"))
    joined = lambda name: F.array_join(F.transform("p", lambda p: p[name]), "")
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p[name])
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


def _sql_extra(column: str) -> str:
    """Characters that escaping adds."""
    return f"(length({column}) - length(replace({column}, '\\', '')))" + "".join(f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS)


ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
s AS (SELECT *, length(text) + {_sql_extra("text")} + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())} ELSE length(role) + {_sql_extra("role")} + {sum(map(len, OTHER))} END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
