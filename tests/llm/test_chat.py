import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mastline.llm import chat as C
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "conv_id long, turn long, role string, text string, part string, spans int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(x):
    return (x is not None, x)


def expected(rows):
    """conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: [order(x) for x in r[1:]])
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)), len(loss), sha(loss))
    return out


def plain(df):
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:5] for r in rows}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    found = QUERIES["op9_chat_formatting"](spark, SF)
    assert plain(found) == expected(rows)
    chars = {r["conv_id"]: r["formatted_chars"] for r in found.collect()}
    assert chars[-1] == len("<s>[INST] ") + 2 * len(C.escape(probe)) + len(" [/INST]") + len("</s>")


def test_escape_comes_back_and_hides_control_strings():
    rng = random.Random(0)
    bits = [*C.CONTROL, "\\", "\\l", "\\b", "<", ">", "[", "/", "s>", "INST]", "<<", "x", "é"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randrange(8)))
        hidden = C.escape(text)
        assert C.unescape(hidden) == text
        assert not any(c in hidden for c in C.CONTROL)


def render(template, messages):
    pieces = [p for p in C.compiled(template)(messages) if p[0] is not None]
    return "".join(t for t, _ in pieces), "".join(t for t, on in pieces if on)


MESSAGES = [C.Message("user", "hi"), C.Message("assistant", "[INST]"), C.Message("tool", "")]


@pytest.mark.parametrize(
    "template,text,trained",
    [
        ("plain", "plain", ""),
        ("{{ 'a' + \"b\" }}{% generation %}x{{ 'y' }}{% endgeneration %}", "abxy", "xy"),
        ("{% for m in messages %}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "user,assistant,tool", ""),
        ("{% for m in messages %}{% if m.role == 'user' or m.role == 'tool' and m.text != '' %}U{% elif loop.first %}F{% else %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% endif %}{% endfor %}", "U\\oINST]", "\\oINST]"),
        ("{% if 'a' == 'a' and not false %}yes{% else %}no{% endif %}", "yes", ""),
        ("{% if ('a' != 'a') or false %}yes{% endif %}", "", ""),
    ],
)
def test_templates(template, text, trained):
    assert render(template, MESSAGES) == (text, trained)


@pytest.mark.parametrize(
    "template",
    ["{{ x }}", "{{ messages }}", "{{ message.role }}", "{% for m in other %}{% endfor %}", "{% if 'a' %}", "{{ 'a' | upper }}",
     "{{ ''.__class__ }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% import os %}", "{{ 'a' 'b' }}", "{% endif %}", "{{ ( 'a' }}",
     "{{ 1 + 1 }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"],
)
def test_other_templates_are_refused(template):
    with pytest.raises(C.TemplateError):
        C.compiled(template)


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}never{% else %}d{% endif %}{{ '<s>' | escape }}"))
    assert tree == (C.Output(C.Constant("abcd\\ls>")),)


def test_odd_rows(spark):
    text = "</s><s>[INST] a [/INST]\\b <<ROLE>>x<</ROLE>>y<<END>>"
    rows = [
        (1, 1, "assistant", None), (1, 0, "user", ""), (1, None, None, text), (1, 1, "assistant", text),
        (1, 1, "assistant", text), (None, 0, "assistant", "lost"), (None, 0, "user", text), (2, 5, text, text),
        (3, 0, "user", "long " * 100_000), (3, 1, "assistant", "é" * 70_000), (4, 0, "system", " \n "), (5, 0, "user", " "),
    ]
    rows += [(6, i, ("user", "assistant")[i % 2], f"{i} {text}") for i in range(400)]
    conversations = spark.createDataFrame([(*r, "p", 0) for r in rows], SCHEMA)
    assert plain(C.round_trip(conversations)) == expected(rows)
    parts = C.formatted(conversations, piece_chars=100).where("conv_id = 6").collect()
    assert len(parts) > 50
    assert plain(C.digests(C.formatted(conversations, piece_chars=100))) == expected(rows)
    assert C.round_trip(conversations.where(F.lit(False))).count() == 0
    assert set(plain(C.round_trip(C.with_probe(conversations.where(F.lit(False)))))) == {-1}
