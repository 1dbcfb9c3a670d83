"""Chat formatting with loss spans, found by rendering alone.

A template is a black box that renders a list of turns. Successive prefixes of a conversation are rendered
and compared: what the longer output has more than the shorter one is the last turn's span. A text that the
last turn's text is swapped for then shows where in its span the text lies. A template whose output for
more turns does not continue the earlier one, but for a constant tail, rewrites history; that is reported with
the turn at which it happens, and no spans are given, as none can be trusted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Private-use characters of which the text is made that stands for another when its place is sought.
RUN, EDGE = "\ue000", "\ue001"


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...


class MarkedTurns:
    """``### role: text </turn>`` and a line feed per turn; control strings inside are escaped.

    A backslash goes before every backslash, ``###`` and ``</turn>`` of a text, and before colons of a role.
    """

    CONTROL = r"(\\|###|</turn>)"
    ROLE_CONTROL = r"(\\|###|</turn>|:)"
    ESCAPED = r"\\(\\|###|</turn>|:)"
    HEADER = r"^### ((?s:.*)): $"

    def render(self, turns: list[Turn]) -> str:
        return "".join(
            f"### {re.sub(self.ROLE_CONTROL, r'\\\1', role)}: {re.sub(self.CONTROL, r'\\\1', text)} </turn>\n" for role, text in turns
        )

    @classmethod
    def text(cls, formatted: Column) -> Column:
        """What was escaped, as it was."""
        return F.regexp_replace(formatted, r"\\(\\|###|</turn>)", "$1")

    @classmethod
    def role(cls, header: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(header, cls.HEADER, 1), cls.ESCAPED, "$1")


def probe_for(texts: list[str]) -> str:
    """A text that none of the texts holds, nor any text put together of them and it at another place than its own.

    It is a run of one character, longer than any in the texts, between two others: no neighbour makes it longer.
    """
    longest = max((len(run) for text in texts for run in re.findall(f"{RUN}+", text)), default=0)
    return EDGE + RUN * (longest + 1) + EDGE


def located(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]] | None, int | None]:
    """The rendered conversation; per turn the span and within it the text's span; where history is rewritten.

    Positions are code points. Each turn costs two renderings of its prefix.
    """
    before, spans = template.render([]), []
    probe = probe_for([template.render(turns), *(part for turn in turns for part in turn)])
    for k in range(1, len(turns) + 1):
        output = template.render(turns[:k])
        start = len(before) if output.startswith(before) else len(commonprefix([before, output]))
        tail = before[start:]
        if not output.endswith(tail) or len(output) - len(tail) < start or (spans and start < spans[-1][1]):
            return template.render(turns), None, k - 1
        end = len(output) - len(tail)
        probed = template.render([*turns[: k - 1], (turns[k - 1][0], probe)])
        at = probed.find(probe, start)
        rest = len(probed) - at - len(probe) - len(tail) if at >= 0 else -1
        if rest < 0 or not output.startswith(probed[:at]) or end - rest < at:
            return template.render(turns), None, k - 1
        spans.append((start, end, at, end - rest))
        before = output
    return before, spans, None


SPANS = "array<struct<start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_chats(rows: DataFrame, template: Template, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted``, ``spans`` and ``rewritten_at`` per conversation.

    ``rows`` has ``conv_id, turn, role, text``; null roles and texts are empty, null turns come first, and rows
    of one turn are ordered by role and text. Rows without a conv_id form one conversation. Repeated rows are
    turns of their own. ``spans`` is null where the template rewrites history, ``rewritten_at`` is null elsewhere.
    Conversations come sorted to the tasks, which hold one at a time; rendering prefixes takes time as the square of a
    conversation's turns. Other columns are not read; no rows give no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition(partitions, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    place = pa.struct([(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns = None, []

        def one(id_type: pa.DataType) -> pa.RecordBatch:
            text, found, at = located(template, turns)
            spans = found and [
                dict(zip(("start", "end", "text_start", "text_end"), s), loss=role == loss_role) for s, (role, _) in zip(found, turns)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([current], id_type), pa.array([text], pa.string()), pa.array([spans], pa.list_(place)), pa.array([at], pa.int32())],
                names=["conv_id", "formatted", "spans", "rewritten_at"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if turns and conv != current:
                    yield one(id_type)
                    turns = []
                current = conv
                turns.append((role, text))
        if turns:
            yield one(id_type)

    return ordered.mapInArrow(work, f"conv_id {kind}, formatted string, spans {SPANS}, rewritten_at int")
