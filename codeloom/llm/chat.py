"""Operator 6, chat formatting by compiled templates."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Batches, partitions
from codeloom.llm.template import Template

#: A turn is [TURN] role [TEXT] text [END]; texts and roles never hold a bracket or angle that is not escaped.
CHAT_TEMPLATE = "{% for m in messages %}[TURN]{{ m.role | control }}[TEXT]{% if m.role == 'assistant' %}{% generation %}{{ m.text | control }}{% endgeneration %}{% else %}{{ m.text | control }}{% endif %}[END]\n{% endfor %}"
_CONTROL, _ESCAPED = re.compile(r"[\\\[\]<>]"), re.compile(r"\\(.)", re.S)
_TEXTS = ("formatted", "turns_sha256", "loss_sha256")
_COLUMNS = ("conv_id", "formatted", "spans", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
_FORMATTED = pa.schema([(c, pa.list_(pa.list_(pa.int32())) if c == "spans" else pa.string() if c in _TEXTS else pa.int64()) for c in _COLUMNS])
_TURN = re.compile(r"\[TURN\](.*?)\[TEXT\](.*?)\[END\]\n", re.S)


def escape(text: str | None) -> str:
    """With a backslash before every character that control strings are made of, and before backslashes."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def compiled(source: str = CHAT_TEMPLATE) -> Template:
    return Template(source, {"control": escape})


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation.

    Escaped brackets follow a backslash, so the markers are found by their
    first unescaped bracket only: an escaped text holds no bare bracket.
    """
    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]
    return turns


def format_turns(turns: list[tuple[str | None, str | None]], template: Template) -> tuple[str, list[tuple[int, int]]]:
    return template.render({"messages": [{"role": r or "", "text": t or ""} for r, t in turns]})


def digest(formatted: str, spans: list[tuple[int, int]]) -> dict:
    turns = read_back(formatted)
    loss = "".join(unescape(formatted[a:b]) for a, b in spans)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return {"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(formatted)}


def conversations(turns: DataFrame, source: str = CHAT_TEMPLATE) -> DataFrame:
    """Each conversation formatted: conv_id, formatted, spans (start and end of each text under the loss mask), and the digest columns.

    turns: conv_id, turn, role, text; other columns are not read. Null text
    and role are empty; a null turn comes first; turns that repeat a number
    are ordered by role and text, and all are kept. Rows without conv_id are
    one conversation. An empty table gives no rows. Turns are sorted within
    the partitions of conv_id, so a task streams conversations and holds one.
    """
    spark = turns.sparkSession
    template = compiled(source)

    def run(batches: Batches) -> Batches:
        held, now, out = [], None, []

        def done() -> dict:
            formatted, spans = format_turns(held, template)
            return {"conv_id": now, "formatted": formatted, "spans": [list(s) for s in spans]} | digest(formatted, spans)

        for b in batches:  # ids stay whole numbers: a null beside them would make floats of them in pandas
            for c, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if held and c != now:
                    out.append(done())
                    held = []
                now = c
                held.append((r, t))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([done()], schema=_FORMATTED)

    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, formatted string, spans array<array<int>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings of a common template."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def with_probe(turns: DataFrame, source: str = CHAT_TEMPLATE) -> DataFrame:
    """`conversations` of the turns and, apart from them, of the probe: a conversation -1 that the table has already stays another one."""
    return conversations(turns, source).unionByName(conversations(probe(turns.sparkSession), source))
