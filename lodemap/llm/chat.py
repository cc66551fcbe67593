"""Chat formatting by schema fingerprints, inside the JVM.

Records of any layout stand in one struct column; what a layout lacks is null. The nested field paths that a record
fills, of those that any mapping names, are sorted and hashed. The hash selects a declarative mapping, which turns the
record into canonical turns (role, text). Turns are written into one string whose control strings mark them; control
strings inside roles and texts are escaped, and read back unchanged. The loss mask is a list of runs over that string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Role names of public chat layouts and what they stand for.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, ASK, ANSWER, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"  # a turn; its text, outside and under the loss; its end
_REST = r"(?:<\\*(?=/?s>))|(?:\[\\*(?=/?INST\]))"  # the head of a control string, with the escapes that it has


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that it needs, those that it may have, and the turns that they make.

    A path names nested fields with dots; ``[]`` stands for the elements of an array. ``turns`` lists (role, path) of
    single fields, or is one (role path, text path) pair of an array's elements, with ``listed`` set.
    """

    name: str
    needs: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    may: tuple[str, ...] = ()
    listed: bool = False
    aliases: bool = False


#: Public layouts of instruction and chat data.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (("role", "content"),), listed=True),
    Mapping("share", ("conversations[].from", "conversations[].value"), (("from", "value"),), listed=True, aliases=True),
    Mapping("instruction", ("instruction", "output"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output")), may=("input", "system")),
    Mapping("prompt", ("prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response")), may=("system",)),
    Mapping("completion", ("prompt", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), may=("system",)),
    Mapping("question", ("question", "answer"), (("system", "system"), ("user", "question"), ("assistant", "answer")), may=("system",)),
    Mapping("dialogue", ("data.turns[].speaker.role", "data.turns[].text"), (("speaker.role", "text"),), listed=True, aliases=True),
)


def fingerprint_of(paths: Iterable[str]) -> str:
    """Hex digest of a set of field paths."""
    return hashlib.md5(",".join(sorted(paths)).encode()).hexdigest()


def fingerprints(mapping: Mapping) -> list[str]:
    """Those of all sets of paths that a mapping takes."""
    return [fingerprint_of({*mapping.needs, *some}) for n in range(len(mapping.may) + 1) for some in combinations(mapping.may, n)]


def _has(path: str, kind: T.DataType) -> bool:
    """Whether a schema has a path."""
    for part in path.split("."):
        name, listed = part.removesuffix("[]"), part.endswith("[]")
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
        if listed != isinstance(kind, T.ArrayType):
            return False
        kind = kind.elementType if listed else kind
    return True


def _filled(value: Column, path: str) -> Column:
    """Whether a record fills a path: no null on the way, and of an array's elements at least one."""
    head, listed, rest = path.partition("[]")
    for name in filter(None, head.split(".")):
        value = value.getField(name)
    if not listed:
        return value.isNotNull()
    return F.coalesce(F.exists(value, lambda x: _filled(x, rest.removeprefix("."))), F.lit(False))


def fingerprint(record: Column, schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Digest of the paths that a record fills; paths that no mapping names do not count."""
    known = sorted({p for m in mappings for p in (*m.needs, *m.may)})
    there = [F.when(_filled(record, p), F.lit(p)) for p in known if _has(p, schema)]
    return F.md5(F.concat_ws(",", *there).cast("binary")) if there else F.lit(fingerprint_of(()))


_TURNS = "array<struct<role: string, text: string>>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _field(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record.getField(name)
    return record


def _turns(record: Column, m: Mapping, schema: T.StructType) -> Column:
    """The canonical turns of a record of a mapping's layout."""
    if m.listed:
        (role_path, text_path), of = m.turns[0], m.needs[0].partition("[]")[0]

        def one(x: Column) -> Column:
            role = _field(x, role_path)
            if m.aliases:
                role = F.coalesce(*[F.when(role == F.lit(a), F.lit(r)) for a, r in ALIASES.items()], role)
            return _turn(role, _field(x, text_path))

        return F.transform(_field(record, of), one).cast(_TURNS)
    out = []
    for role, path in m.turns:
        parts = [p for p in path.split("+") if _has(p, schema)]
        if parts:
            text = F.concat_ws("\n\n", *[F.nullif(_field(record, p), F.lit("")) for p in parts]) if len(parts) > 1 else _field(record, parts[0])
            there = _field(record, parts[0]).isNotNull()
            out.append(F.when(there, _turn(F.lit(role), text)))
    return F.array_compact(F.array(*out)).cast(_TURNS)


def canonical(records: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add fingerprint, layout (name of the mapping, null where none has the fingerprint) and turns (null then).

    Rows of unknown layouts stay, so that nothing is lost unseen. A null record is one without fields.
    """
    schema = records.schema[column].dataType
    marked = records.withColumn("fingerprint", fingerprint(F.col(column), schema, mappings))
    layout = turns = None
    for m in mappings:
        if all(_has(p, schema) for p in m.needs):
            here = F.col("fingerprint").isin(*fingerprints(m))
            layout = F.when(here, m.name) if layout is None else layout.when(here, m.name)
            made = _turns(F.col(column), m, schema)
            turns = F.when(here, made) if turns is None else turns.when(here, made)
    return marked.withColumn("layout", F.lit(None).cast("string") if layout is None else layout).withColumn("turns", F.lit(None).cast(_TURNS) if turns is None else turns)


def escaped(text: Column) -> Column:
    """One more backslash behind the first character of every control string, escaped or not."""
    return F.regexp_replace(text, F.lit(rf"({_REST})"), F.lit(r"$1\\"))


def unescaped(text: Column) -> Column:
    """The backslash taken out again."""
    return F.regexp_replace(text, F.lit(r"((?:<\\*)(?=\\/?s>)|(?:\[\\*)(?=\\/?INST\]))\\"), F.lit("$1"))


def formatted(turns: DataFrame, answers: str = "assistant") -> DataFrame:
    """Add formatted (string) and mask (runs of loss, chars that cover it in order) for ``turns``; only texts of role ``answers`` are under the loss.

    A turn is ``<s>role[INST]text[/INST]``, an answer ``<s>role[/INST]text</s>``. Null turns give nulls.
    """

    def piece(t: Column) -> Column:
        role, text, loss = escaped(t["role"]), escaped(t["text"]), t["role"] == F.lit(answers)
        head = F.concat(F.lit(OPEN), role, F.when(loss, ANSWER).otherwise(ASK))
        return F.struct(head.alias("head"), text.alias("text"), F.when(loss, CLOSE).otherwise(ANSWER).alias("tail"), loss.alias("loss"))

    runs = F.flatten(F.transform("pieces", lambda p: F.array(*[F.struct(loss.alias("loss"), F.length(p[c]).alias("chars")) for c, loss in (("head", F.lit(False)), ("text", p["loss"]), ("tail", F.lit(False)))])))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return turns.withColumn("pieces", F.transform("turns", piece)).withColumns({"formatted": whole, "mask": runs}).drop("pieces")


def read_back(chats: DataFrame) -> DataFrame:
    """Add read: the turns (role, text, loss) that ``formatted`` and ``mask`` say.

    The control strings cut the string; each turn's run of the mask is its middle one of three.
    """
    parts = F.transform(F.slice(F.split("formatted", OPEN), F.lit(2), F.size(F.split("formatted", OPEN))), lambda t: F.split(t, r"\[/?INST\]|</s>"))
    read = F.transform(parts, lambda t, i: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text"), F.col("mask")[i * 3 + 1]["loss"].alias("loss"), (F.length(t[1]) == F.col("mask")[i * 3 + 1]["chars"]).alias("fits")))
    return chats.withColumn("read", read)


_RECORD = "struct<prompt: string, response: string, system: string, conversations: array<struct<from: string, value: string>>, messages: array<struct<role: string, content: string>>>"


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: conversation rows gathered into the layout that collections of their shape come in.

    One question and answer is a prompt record, with a system turn before it if there is one; longer exchanges of the
    known roles are shared conversations; all others are messages. Rows go by turn (nulls first), role and text; a
    null role or text is empty.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    of = rows.groupBy("conv_id", "extra").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role"), empty("text")))).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])
    short, begun = roles == F.array(F.lit("user"), F.lit("assistant")), roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    names = {"user": "human", "assistant": "gpt", "system": "system"}
    known = F.forall(roles, lambda r: r.isin(*names)) & (F.size("rows") > 3)
    text = lambda k: F.col("rows")[k]["text"]
    share = F.transform("rows", lambda r: F.struct(F.when(r["role"] == "user", "human").when(r["role"] == "assistant", "gpt").otherwise(r["role"]).alias("from"), r["text"].alias("value")))
    plain = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    none: Callable[[str], Column] = lambda kind: F.lit(None).cast(kind)
    prompt = F.when(short, text(0)).when(begun, text(1))
    record = F.struct(
        prompt.alias("prompt"),
        F.when(short, text(1)).when(begun, text(2)).alias("response"),
        F.when(begun, text(0)).alias("system"),
        F.when(~short & ~begun & known, share).otherwise(none("array<struct<from: string, value: string>>")).alias("conversations"),
        F.when(~short & ~begun & ~known, plain).otherwise(none("array<struct<role: string, content: string>>")).alias("messages"),
    )
    return of.select("conv_id", record.cast(_RECORD).alias("record"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Contract rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and layout, fits (the mask's runs have the lengths read).

    Besides the table there is conversation -1, whose texts hold control strings. Rows of a null conv_id are one
    conversation, null roles and texts are empty, repeated rows are turns of their own. The digest of a conversation is
    over all of its turns, so a conversation is one row, of at most 2 GB. Other columns are ignored.
    """
    spark = conversations.sparkSession
    said = f"{CLOSE}{ASK} ok {ANSWER}"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(True))
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(False).alias("extra"))
    chats = formatted(canonical(as_records(slim.unionByName(own)), "record")).select("conv_id", "layout", "formatted", "mask")
    read = read_back(chats)
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
        F.forall("read", lambda t: t["fits"]).alias("fits"),
    )


#: DuckDB SQL for the rows of ``chat_report`` over the table conversations.
REPORT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS extra FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]', true FROM range(2) t(k)
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'))
    + length(regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'))
    + 3 + CASE role WHEN 'assistant' THEN 7 + 4 ELSE 6 + 7 END AS chars
  FROM said
), gathered AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(chars) AS chars, bool_and(role IN ('user', 'assistant', 'system')) AS known, list(role ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM sized GROUP BY conv_id, extra
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] OR roles = ['system', 'user', 'assistant'] THEN 'prompt'
    WHEN n_turns > 3 AND known THEN 'share' ELSE 'messages' END AS layout,
  true AS fits
FROM gathered
"""
