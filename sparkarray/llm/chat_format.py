"""Chat formatting with a small template compiler.

A template language of text, ``{{ expression }}``, ``{% for x in y %}``,
``{% if c %}/{% else %}`` and ``{% generation %}`` is parsed into a syntax tree.
Expressions know names, fields, string literals, ``==``, ``!=``, ``+``, ``not``,
``and``, ``or`` and a fixed set of filters; there is no call, no attribute of a
Python object and no import, so a template can reach nothing but the values it is
given.  Constants are folded and neighbouring texts joined; then every node
becomes a Python closure.  A rendering is a stream of (text, under the loss mask)
pieces: a long conversation never has to be held as one string.

The default template marks turns with control strings.  Inside texts and roles
these are escaped reversibly: a backslash is doubled, and a control string (also
those of other common templates) gets a backslash behind its first character.

Cases: a null text or role counts as empty; turns with the same number are
ordered by role, then text; repeated rows are repeated turns; rows without a
conversation id form a conversation of their own; very long texts are escaped
whole; a conversation is one task's, which reads it turn by turn from a sort that
spills, so its length is bound by time only; other columns of the input, whatever
their names, are left out; an empty table gives an empty result but for added
conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import parallelism, table

START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, escaped inside texts besides our own.
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
CONTROLS = [START, MIDDLE, END, *FOREIGN]
TEMPLATE = (
    "{% for turn in turns %}" + START + "{{ turn.role | escape }}" + MIDDLE
    + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}" + END + "{% endfor %}"
)

_CONTROL = re.compile(r"\\|(?:" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without any control string; :func:`unescape` gives it back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
Piece = tuple[str, bool]
Render = Callable[[dict[str, Any]], Iterator[Piece]]


class TemplateError(ValueError):
    """The template is not in the language."""


# --- syntax tree: ("text", s) ("out", expr) ("for", name, expr, body) ("if", expr, body, other) ("gen", body)
# --- expressions: ("const", v) ("name", n) ("field", e, n) ("filter", e, n) ("not", e) (operator, a, b)

_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[|.+()]))")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens: list[str] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *allowed: str) -> str:
        token = self.peek()
        if not token or allowed and token not in allowed:
            raise TemplateError(f"expected {allowed or 'more'}, found {token!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        found = self.either()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return found

    def either(self) -> tuple:
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.peek() == "and":
            self.take()
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        left = self.joined()
        if self.peek() in ("==", "!="):
            return (self.take(), left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.single()
        while self.peek() in ("|", "."):
            if self.take() == ".":
                name = self.take()
                if not name.isidentifier() or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                left = ("field", left, name)
            else:
                name = self.take()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                left = ("filter", left, name)
        return left

    def single(self) -> tuple:
        token = self.take()
        if token == "(":
            found = self.either()
            self.take(")")
            return found
        if token[0] in "'\"":
            return ("const", _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], token[1:-1]))
        if not token.isidentifier() or token.startswith("_"):
            raise TemplateError(f"no name {token!r}")
        return ("name", token)


def parse(template: str) -> list[tuple]:
    """The template's syntax tree."""
    parts = [p for p in _PART.split(template) if p]
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                words = part[2:-2].split(None, 1)
                word, rest = words[0], words[1] if len(words) > 1 else ""
                if word in ends:
                    return nodes, word
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                    if not m:
                        raise TemplateError(f"bad loop {rest!r}")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    yes, end = block("else", "endif")
                    nodes.append(("if", _Expression(rest).whole(), yes, block("endif")[0] if end == "else" else []))
                elif word == "generation":
                    nodes.append(("gen", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            else:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block()[0]


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold_expression(e: tuple) -> tuple:
    """Constant folding: an expression of constants becomes its value."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind in ("field", "filter"):
        inner = fold_expression(e[1])
        return ("const", FILTERS[e[2]](inner[1])) if kind == "filter" and inner[0] == "const" else (kind, inner, e[2])
    if kind == "not":
        inner = fold_expression(e[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expression(e[1]), fold_expression(e[2])
    return ("const", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Folds expressions, decides constant branches and joins neighbouring texts."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", str(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "if":
            e = fold_expression(node[1])
            if e[0] == "const":
                for inner in fold(node[2] if e[1] else node[3]):
                    add(inner)
            else:
                add(("if", e, fold(node[2]), fold(node[3])))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "gen":
            add(("gen", fold(node[1])))
        else:
            add(node)
    return out


def _value(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n, "")
    if kind == "field":
        return lambda scope, f=_value(e[1]), n=e[2]: f(scope).get(n, "")
    if kind == "filter":
        return lambda scope, f=_value(e[1]), g=FILTERS[e[2]]: g(f(scope))
    if kind == "not":
        return lambda scope, f=_value(e[1]): not f(scope)
    return lambda scope, f=_value(e[1]), g=_value(e[2]), h=_OPERATORS[kind]: h(f(scope), g(scope))


def _closure(nodes: list[tuple], masked: bool = False) -> Render:
    steps: list[Render] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, piece=(node[1], masked): iter((piece,)))
        elif node[0] == "out":
            steps.append(lambda scope, f=_value(node[1]): iter(((str(f(scope)), masked),)))
        elif node[0] == "gen":
            steps.append(_closure(node[1], True))
        elif node[0] == "if":
            steps.append(lambda scope, f=_value(node[1]), yes=_closure(node[2], masked), no=_closure(node[3], masked): (yes if f(scope) else no)(scope))
        else:

            def loop(scope: dict, name: str = node[1], f: Callable = _value(node[2]), body: Render = _closure(node[3], masked)) -> Iterator[Piece]:
                for item in f(scope):
                    yield from body({**scope, name: item})

            steps.append(loop)

    def render(scope: dict[str, Any]) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return render


def compile_template(template: str) -> Render:
    """Parse, fold, and generate the closures."""
    return _closure(fold(parse(template)))


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """Reads a rendering back, turn by turn: role, text, and the text under the mask."""
    held: list[str] = []
    masked: list[str] = []
    for text, under in pieces:
        if under:
            masked.append(text)
        held.append(text)
        if END in text and not under:
            *whole, rest = "".join(held).split(END)
            for turn in whole:
                if not turn.startswith(START):
                    raise ValueError("the rendering has text outside of turns")
                role, _, body = turn[len(START) :].partition(MIDDLE)
                yield unescape(role), unescape(body), unescape("".join(masked))
                masked = []
            held = [rest]
    if "".join(held):
        raise ValueError("the rendering ends inside a turn")


def digest(turns: Iterable[dict[str, str]], render: Render) -> tuple[int, str, int, str, int]:
    """Renders a conversation and reads it back, turn by turn, into its digests."""
    said, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0

    def counted() -> Iterator[Piece]:
        nonlocal chars
        for piece in render({"turns": turns}):
            chars += len(piece[0])
            yield piece

    for role, text, masked in read_turns(counted()):
        n += 1
        said.update(f"{role}\n{text}\n".encode())
        loss.update(masked.encode())
        loss_chars += len(masked)
    return n, said.hexdigest(), loss_chars, loss.hexdigest(), chars


def _sorted_rows(chats: DataFrame) -> DataFrame:
    spark = chats.sparkSession
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict[str, str]]]]:
    """Conversations of a sorted partition, each a stream of its turns."""
    rows = ((c, r, t) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    for conv, own in groupby(rows, key=lambda x: x[0]):
        yield conv, ({"role": r, "text": t} for _, r, t in own)


def format_digests(chats: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation with digests of what its rendering says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []
        for conv, turns in _streamed(batches):
            out.append((conv, *digest(turns, render)))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return _sorted_rows(chats).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(chats: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: the rendering and the [start, end) spans under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, turns in _streamed(batches):
            texts, spans, at = [], [], 0
            for text, under in render({"turns": turns}):
                if under and text:
                    spans.append([at, at + len(text)])
                texts.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(texts)]), pa.array([spans], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    return _sorted_rows(chats).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings."""
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return format_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added))


QUERIES = {"op7_chat_formatting": op7_chat_formatting}


def _escaped_length(column: str) -> str:
    """SQL: how long an escaped text is: one more for each backslash and each control string."""
    return " + ".join([f"length({column})", *(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))])


ORACLE_SQL = {
    "op7_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
          CAST(sum({len(START + MIDDLE + END)} + {_escaped_length("role")} + {_escaped_length("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
}
