"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block by array aggregation; blocks are concatenated, and the assistant's texts are
marked by spans.

    <|turn|>ROLE<|text|>TEXT<|more|>NEXT TEXT OF THE SAME ROLE<|end|>

Control strings inside roles and texts are escaped by a backslash after their first character
(one more where backslashes stand there already), which `unescape` takes back exactly.

Defined results: null text or role is empty; turns are ordered by turn (null first), role and
text, and repeated rows are turns of their own; rows with a null conversation id form one
conversation; only the four named columns are read. A conversation becomes one row, so one
must fit a task; the prefix sum of its spans copies 16 bytes a turn for each later turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, MORE, CLOSE = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
#: This template's control strings, and those of other common templates. None has `<` or `[` after its first character.
CONTROLS = (OPEN, BODY, MORE, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLES = ("assistant",)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\|[](){}.*+?^$/" else c for c in text)


_RESTS = "|".join(_quoted(c[1:]) for c in CONTROLS)
ESCAPE = rf"([<\[])(\\*)({_RESTS})"
UNESCAPE = rf"([<\[])\\(\\*)({_RESTS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def format_chat(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES
) -> DataFrame:
    """One row for each conversation: `conv_col`, formatted, and loss_spans: (start, end) in code points of the texts to learn from."""
    empty = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text")
    )
    rows = df.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    rows = rows.withColumn("escaped", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))))
    # where a run of one role starts, and its turns put together: each turn is copied once
    same = lambda i: F.coalesce(F.get("escaped", i - 1)["role"] == F.get("escaped", i)["role"], F.lit(False))
    rows = rows.withColumn("first", F.filter(F.sequence(F.lit(0), F.size("escaped") - 1), lambda i: ~same(i)))

    def run(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("first", k + 1), F.size("escaped"))
        return F.struct(F.get("escaped", first)["role"].alias("role"), F.transform(F.slice("escaped", first + 1, after - first), lambda t: t["text"]).alias("texts"))

    rows = rows.select("conv", F.transform("first", run).alias("runs"))
    block = lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit(BODY), F.array_join(r["texts"], MORE), F.lit(CLOSE))
    return rows.select(F.col("conv").alias(conv_col), F.array_join(F.transform("runs", block), "").alias("formatted"), _spans(F.col("runs"), loss_roles).alias("loss_spans"))


#: Turns whose spans are summed together; the sums of these chunks are summed in turn.
CHUNK = 256
SPANS = "array<struct<start:bigint,end:bigint>>"


def _spans(runs: Column, loss_roles: tuple[str, ...]) -> Column:
    """Start and end of each text of `loss_roles` in the formatted conversation: running sums of lengths, in chunks, so that a long conversation does not copy all earlier spans for each turn."""
    size = lambda c: F.length(c).cast("long")

    def parts(r: Column) -> Column:
        n = F.size(r["texts"])
        head = F.lit(len(OPEN) + len(BODY)).cast("long") + size(escape(r["role"]))
        gap = lambda j: F.when(j == 0, head).otherwise(F.lit(len(MORE)).cast("long"))
        tail = lambda j: F.when(j == n - 1, F.lit(len(CLOSE)).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.transform(r["texts"], lambda t, j: F.struct(gap(j).alias("head"), size(t).alias("body"), tail(j).alias("tail"), r["role"].isin(*loss_roles).alias("loss")))

    none = F.array().cast(SPANS)
    zero = F.lit(0).cast("long")

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["head"]
        end = begin + p["body"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + p["tail"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def place(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def laid(flat: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(CHUNK)), lambda i: F.slice(flat, i, F.lit(CHUNK)))
        own = F.transform(cut, lambda c: F.aggregate(c, F.struct(zero.alias("at"), none.alias("spans")), add))
        return _with(own, lambda o: F.flatten(F.zip_with(o, F.aggregate(o, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts")), place, lambda a: a["starts"]), _moved)))

    return _with(F.flatten(F.transform(runs, parts)), laid)


def _moved(chunk: Column, by: Column) -> Column:
    return F.transform(chunk["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def _with(value: Column, f) -> Column:
    """f(value), where f names it more than once but it is to be worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    quoted = lambda c: F.lit(_quoted(c))
    blocks = F.filter(F.split(formatted, quoted(CLOSE)), lambda b: b != "")

    def one(b: Column) -> Column:
        inside = F.regexp_replace(b, F.lit("^" + _quoted(OPEN)), F.lit(""))
        halves = F.split(inside, quoted(BODY), 2)
        role = unescape(halves[0])
        return F.transform(F.split(halves[1], quoted(MORE)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, one))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss spans, in order, nothing between."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(text))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = F.col("turns")
    return (
        format_chat(rows)
        .withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def _sql() -> str:
    text = "</s>[INST] ok [/INST]"
    esc = lambda c: f"regexp_replace({c}, '{ESCAPE}', '\\1\\\\\\2\\3', 'g')"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{text}' UNION ALL SELECT -1, 1, 'assistant', '{text}'
), s AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first, lead(role) OVER w IS DISTINCT FROM role AS last
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({esc("text")}) + CASE WHEN first THEN length({esc("role")}) + {len(OPEN) + len(BODY)} ELSE {len(MORE)} END
    + CASE WHEN last THEN {len(CLOSE)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


SQL = {"op5_chat": _sql()}
