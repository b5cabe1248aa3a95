"""Chat formatting: a compiler for a small sandboxed template language.

    {{ expression }}                              its text
    {% for message in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      text that a model is trained on
    expressions: 'text', names, message.role, message.text, loop.first, loop.last, ==, !=,
    and, or, not, + (joining texts), parentheses, and the filter | escape

Nothing else can be named, so a template reaches no Python object. A template is parsed to a
syntax tree, constants are folded (texts joined, decided branches cut), and each node becomes
a closure that yields (text, trained on) pieces. Messages come as a stream, one ahead for
``loop.last``, so a conversation of any length is rendered in bounded memory.

``escape`` makes every control string in a text harmless and can be undone: a backslash
becomes ``\\b``, and the first character of a control string ``\\l`` for ``<``, ``\\o`` for ``[``.
"""

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.runtime import stored

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "<<END>>")
TEMPLATE = (
    "{% for message in messages %}"
    "{% if loop.first %}<s>{% endif %}"
    "{% if message.role == 'user' %}[INST] {{ message.text | escape }} [/INST]"
    "{% elif message.role == 'assistant' %}"
    "{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}<<ROLE>>{{ message.role | escape }}<</ROLE>>{{ message.text | escape }}<<END>>"
    "{% endif %}{% endfor %}"
)
PIECE_CHARS = 1 << 20  # a formatted conversation is written in rows of about this length
_START = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")[<\\[]")


def escape(text: str) -> str:
    text = text.replace("\\", "\\b")
    return _START.sub(lambda m: "\\l" if m[0] == "<" else "\\o", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([blo])", lambda m: {"b": "\\", "l": "<", "o": "["}[m[1]], text)


class Message(NamedTuple):
    role: str
    text: str


class TemplateError(ValueError):
    """The template is not of the language."""


# syntax tree ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: str | bool


@dataclass(frozen=True)
class Name:
    path: str


@dataclass(frozen=True)
class Operation:
    kind: str  # == != and or not + escape
    parts: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Block:
    """``for`` with a body, or ``generation``."""

    kind: str
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_LEXEME = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|(==|!=|[()+|])|([A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_]+)?))")


def _lexemes(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Expression:
    """Recursive descent, loosest first: or, and, not, comparison, +, filter."""

    def __init__(self, text: str, names: frozenset[str]):
        self.left, self.names = _lexemes(text), names

    def parse(self):
        tree = self._or()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0]!r}")
        return tree

    def _take(self, *wanted: str) -> str | None:
        return self.left.pop(0) if self.left and self.left[0] in wanted else None

    def _chain(self, below, *kinds):
        tree = below()
        while kind := self._take(*kinds):
            tree = Operation(kind, (tree, below()))
        return tree

    def _or(self):
        return self._chain(self._and, "or")

    def _and(self):
        return self._chain(self._not, "and")

    def _not(self):
        return Operation("not", (self._not(),)) if self._take("not") else self._compared()

    def _compared(self):
        return self._chain(lambda: self._chain(self._filtered, "+"), "==", "!=")

    def _filtered(self):
        tree = self._value()
        while self._take("|"):
            if not self._take("escape"):
                raise TemplateError("the only filter is escape")
            tree = Operation("escape", (tree,))
        return tree

    def _value(self):
        if self._take("("):
            tree = self._or()
            if not self._take(")"):
                raise TemplateError("missing )")
            return tree
        if not self.left:
            raise TemplateError("an expression ends early")
        word = self.left.pop(0)
        if word[0] in "'\"":
            return Constant(word[1:-1])
        if word in ("true", "false"):
            return Constant(word == "true")
        if word not in self.names:
            raise TemplateError(f"unknown name {word!r}")
        return Name(word)


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        parts += [("text", template[at : m.start()])] if m.start() > at else []
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", template[at:])] if at < len(template) else []
    if sum(k == "tag" and t.startswith("for ") for k, t in parts) > 1:
        raise TemplateError("messages can be read once")
    tree, end = _body(parts, frozenset(), ())
    if end:
        raise TemplateError(f"unexpected {end}")
    return tree


def _body(parts: list, names: frozenset[str], ends: tuple[str, ...]) -> tuple[tuple, str]:
    """Nodes up to a tag that begins with one of ``ends``, and that tag."""
    out = []
    while parts:
        kind, text = parts.pop(0)
        word = text.split(None, 1)[0] if text.split() else ""
        if kind == "text":
            out.append(Output(Constant(text)))
        elif kind == "value":
            out.append(Output(_Expression(text, names).parse()))
        elif word in ends:
            return tuple(out), text
        elif word == "if":
            out.append(_if(parts, text[2:], names))
        elif word == "generation":
            out.append(Block("generation", "", _body(parts, names, ("endgeneration",))[0]))
        elif m := re.fullmatch(r"for\s+(\w+)\s+in\s+messages", text):
            inner = names | {f"{m[1]}.role", f"{m[1]}.text", "loop.first", "loop.last"}
            out.append(Block("for", m[1], _body(parts, inner, ("endfor",))[0]))
        else:
            raise TemplateError(f"unknown tag {text!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return tuple(out), ""


def _if(parts: list, test: str, names: frozenset[str]) -> If:
    condition = _Expression(test, names).parse()
    then, end = _body(parts, names, ("elif", "else", "endif"))
    if end.startswith("elif"):
        return If(condition, then, (_if(parts, end[4:], names),))
    other = _body(parts, names, ("endif",))[0] if end == "else" else ()
    return If(condition, then, other)


def _operate(kind: str, values: list):
    if kind == "escape":
        return escape(values[0])
    if kind == "not":
        return not values[0]
    a, b = values
    return {"==": a == b, "!=": a != b, "and": a and b, "or": a or b}[kind] if kind != "+" else a + b


def fold(node):
    """The tree with constants worked out, texts joined and decided branches cut."""
    if isinstance(node, tuple):
        out = []
        for child in node:
            child = fold(child)
            for x in child if isinstance(child, tuple) else (child,):
                plain = isinstance(x, Output) and isinstance(x.value, Constant)
                if plain and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Constant):
                    out[-1] = Output(Constant(str(out[-1].value.value) + str(x.value.value)))
                elif not plain or x.value.value != "":
                    out.append(x)
        return tuple(out)
    if isinstance(node, Operation):
        parts = tuple(map(fold, node.parts))
        if all(isinstance(p, Constant) for p in parts):
            return Constant(_operate(node.kind, [p.value for p in parts]))
        return Operation(node.kind, parts)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Block):
        return Block(node.kind, node.name, fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Constant):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    return node


# closures ------------------------------------------------------------------------------


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Constant):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, path=node.path: scope[path]
    parts = [*map(_value, node.parts)]
    if node.kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope, kind=node.kind: _operate(kind, [p(scope) for p in parts])


def _renderer(node) -> Callable[[dict, bool], Iterator[tuple[str | None, bool]]]:
    if isinstance(node, tuple):
        children = [*map(_renderer, node)]

        def all_(scope, trained):
            for child in children:
                yield from child(scope, trained)

        return all_
    if isinstance(node, Output):
        value = _value(node.value)

        def output(scope, trained):
            yield str(value(scope)), trained

        return output
    if isinstance(node, If):
        test, then, other = _value(node.test), _renderer(node.then), _renderer(node.other)
        return lambda scope, trained: then(scope, trained) if test(scope) else other(scope, trained)
    body = _renderer(node.body)
    if node.kind == "generation":
        return lambda scope, trained: body(scope, True)

    def loop(scope, trained, name=node.name):
        messages, first = iter(scope["messages"]), True
        message = next(messages, None)
        while message is not None:
            after = next(messages, None)
            inner = {f"{name}.role": message.role, f"{name}.text": message.text}
            yield from body(scope | inner | {"loop.first": first, "loop.last": after is None}, trained)
            yield None, False  # the end of a turn
            message, first = after, False

    return loop


def compiled(template: str) -> Callable[[Iterable[Message]], Iterator[tuple[str | None, bool]]]:
    """A function from messages to (text, trained on) pieces; a text of None ends a turn."""
    render = _renderer(fold(parse(template)))
    return lambda messages: render({"messages": messages}, False)


# Spark ---------------------------------------------------------------------------------

FORMATTED = "conv_id long, part int, text string, spans array<struct<start:long,end:long>>"


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[Message]]]:
    """Conversations one after the other, each as a stream of its sorted rows."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
    )
    ahead = next(rows, None)

    def messages(conv):
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            row, ahead = ahead, next(rows, None)
            yield Message(row[1] or "", row[2] or "")

    while ahead is not None:
        conv = ahead[0]
        own = messages(conv)
        yield conv, own
        for _ in own:  # what a template left unread
            pass


def _formatted(template: str, piece_chars: int):
    def format_(batches):
        render = compiled(template)
        schema = pa.schema(
            [
                ("conv_id", pa.int64()),
                ("part", pa.int32()),
                ("text", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )

        def row(conv, part, texts, spans):
            columns = [[conv], [part], ["".join(texts)], [spans]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for conv, messages in _conversations(batches):
            part, n, texts, spans = 0, 0, [], []
            for text, trained in render(messages):
                if text is None:
                    if n >= piece_chars:
                        yield row(conv, part, texts, spans)
                        part, n, texts, spans = part + 1, 0, [], []
                    continue
                if text and trained:
                    spans.append({"start": n, "end": n + len(text)})
                texts.append(text)
                n += len(text)
            if n or not part:
                yield row(conv, part, texts, spans)

    return format_


def formatted(
    conversations: DataFrame, template: str = TEMPLATE, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``(conv_id, part, text, spans)``: conversations as training text, and its loss mask.

    Rows of a conversation are taken by turn; nulls first, ties by role and text, repeated
    rows each. Null roles and texts are empty; rows with a null conv_id are one
    conversation. Conversations over ``piece_chars`` are cut at turns into several parts;
    ``spans`` are offsets of code points in their part. Further columns are not read; an
    empty table gives an empty one. Rows stream through sorted, so that one conversation
    with a third of all rows needs no more memory than any.
    """
    compiled(template)  # a wrong template fails here
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_formatted(template, piece_chars), FORMATTED)
    )


_TURN = re.compile(
    r"(?:<s>)?(?:\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)<<END>>"
    r"|(?P<assistant>.*?)</s>)",
    re.DOTALL,
)


def turns(text: str) -> Iterator[Message]:
    """The messages of a text that ``TEMPLATE`` made; an error if it made no such text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        if kind == "other":
            yield Message(unescape(m["role"]), unescape(m["other"]))
        else:
            yield Message(kind, unescape(m[kind]))
        at = m.end()


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)


def _digested(batches) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "spans"))
            yield from zip(*columns, strict=True)

    names = [c.split()[0] for c in DIGESTS.split(", ")]
    conv, state = None, None

    def row():
        n, all_, loss_n, loss, chars = state
        values = [conv, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names
        )

    for own, text, spans in parts():
        if state is None or own != conv:
            if state is not None:
                yield row()
            conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for message in turns(text):
            state[0] += 1
            state[1].update(f"{message.role}\n{message.text}\n".encode())
        for span in spans:
            trained = unescape(text[span["start"] : span["end"]])
            state[2] += len(trained)
            state[3].update(trained.encode())
        state[4] += len(text)
    if state is not None:
        yield row()


def digests(written: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from their texts and spans."""
    return (
        written.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(_digested, DIGESTS)
    )


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, read back and digest all conversations."""
    return digests(stored(formatted(conversations), "chat"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations and number -1, whose texts are control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user"), (-1, 1, "assistant")], "conv_id long, turn long, role string"
    ).withColumn("text", text)
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
