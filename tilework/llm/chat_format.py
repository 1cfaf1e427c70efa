"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is text with {{ expression }} and {% statement %}: for x in y, if / elif / else, set x = expression, generation
(the text inside is what a model is trained on). Expressions: names, fields of mappings (x.role), 'strings', numbers, true,
false, none, + ~ == != and or not, and the filters of FILTERS; loops know loop.first, loop.index. There are no calls, no attributes of
Python objects, no imports: a template can read what it is given and nothing else. parse() gives a syntax tree, fold()
evaluates what is constant in it, compiled() turns it into generators that yield (text, masked) pieces, so a conversation
of any length streams through.

The template used here marks turns and escapes control strings in roles and texts reversibly: a backslash, and the
control strings, get a backslash before them.

Conversations are dealt by id and sorted by turn, role, text (nulls first); each streams through one task with the memory
of one turn, as one hash over a conversation demands. Defined results: null texts and roles are empty; a null id is one
conversation; repeated rows are turns of their own; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import table

OPEN, CLOSE = "<turn>", "</turn>"
CONTROL = re.compile(r"\\|</?turn>")
TEMPLATE = """{% set begin = '<' ~ 'turn>' %}{% for m in turns %}{{ begin }}{{ m.role | escape | oneline }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ '</turn>' ~ newline }}{% endfor %}"""


def escape(s: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(str(v)),
    "oneline": lambda v: str(v).replace("\n", "\\n"),
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
}
TOKENS = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[.|~+()]))")


class TemplateError(ValueError):
    pass


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while code[at:].strip():
        m = TOKENS.match(code, at)
        if not m:
            raise TemplateError(f"unexpected text in {code!r}")
        kind = ("number", "string", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, atoms."""

    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {code!r}")

    def next(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, part, *signs):
        left = part()
        while sign := self.next(*signs):
            left = (sign, left, part())
        return left

    def either(self):
        return self.chain(lambda: self.chain(self.negated, "and"), "or")

    def negated(self):
        return ("not", self.negated()) if self.next("not") else self.chain(lambda: self.chain(self.filtered, "~", "+"), "==", "!=")

    def filtered(self):
        left = self.atom()
        while self.next("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = ("filter", name, left)
        return left

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("const", int(value))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], value[1:-1]))
        if value == "(":
            inner = self.either()
            if not self.next(")"):
                raise TemplateError("a parenthesis is not closed")
            return inner
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none", "newline"):
            return ("const", {"true": True, "false": False, "none": None, "newline": "\n"}[value])
        tree = ("name", value)
        while self.next("."):
            kind, field = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or field.startswith("_"):
                raise TemplateError(f"no field {field!r}")
            self.at += 1
            tree = ("field", tree, field)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree: ("block", parts)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    stack: list[tuple[str, Any, list]] = [("block", None, [])]

    def close(*kinds: str):
        if stack[-1][0] not in kinds:
            raise TemplateError(f"{kinds[0]} is not open")
        return stack.pop()

    for part in parts:
        here = stack[-1][2]
        if part.startswith("{{"):
            here.append(("emit", _Expression(part[2:-2]).tree))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"\s*(\w+)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"for {rest!r}")
                stack.append(("for", (m[1], _Expression(m[2]).tree), []))
            elif word == "set":
                m = re.fullmatch(r"\s*(\w+)\s*=(?!=)(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"set {rest!r}")
                here.append(("set", m[1], _Expression(m[2]).tree))
            elif word == "if":
                stack += [("if", [], []), ("branch", _Expression(rest).tree, [])]
            elif word in ("elif", "else"):
                _, test, body = close("branch")
                stack[-1][1].append((test, ("block", body)))
                stack.append(("branch", _Expression(rest).tree if word == "elif" else ("const", True), []))
            elif word == "endif":
                _, test, body = close("branch")
                stack[-1][1].append((test, ("block", body)))
                _, branches, _ = close("if")
                stack[-1][2].append(("if", branches))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                body = close("generation")[2]
                stack[-1][2].append(("generation", ("block", body)))
            elif word == "endfor":
                _, (name, over), body = close("for")
                stack[-1][2].append(("for", name, over, ("block", body)))
            else:
                raise TemplateError(f"no statement {word!r}")
        elif part:
            here.append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][2])


def _operate(sign: str, a, b):
    if sign == "~":
        return f"{'' if a is None else a}{'' if b is None else b}"
    return a + b if sign == "+" else a == b if sign == "==" else a != b


def fold(tree: tuple, known: dict | None = None) -> tuple:
    """The tree with constant expressions evaluated, constants set at the top put in, dead branches cut, texts merged."""
    known = {} if known is None else known
    kind = tree[0]
    if kind == "name":
        return ("const", known[tree[1]]) if tree[1] in known else tree
    if kind == "field":
        return ("field", fold(tree[1], known), tree[2])
    if kind == "filter":
        inner = fold(tree[2], known)
        return ("const", FILTERS[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1], known)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in ("~", "+", "==", "!="):
        a, b = fold(tree[1], known), fold(tree[2], known)
        return ("const", _operate(kind, a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(tree[1], known), fold(tree[2], known)
        return ((b if bool(a[1]) == (kind == "and") else a) if a[0] == "const" else (kind, a, b))
    if kind == "emit":
        inner = fold(tree[1], known)
        return ("text", "" if inner[1] is None else str(inner[1])) if inner[0] == "const" else ("emit", inner)
    if kind == "set":
        return ("set", tree[1], fold(tree[2], known))
    if kind == "generation":
        return ("generation", fold(tree[1], known))
    if kind == "for":
        inner = {k: v for k, v in known.items() if k not in (tree[1], "loop") and k not in _assigned(tree[3])}
        return ("for", tree[1], fold(tree[2], known), fold(tree[3], inner))
    if kind == "if":
        kept = []
        for test, body in tree[1]:
            test = fold(test, known)
            if test[0] == "const" and not test[1]:
                continue
            kept.append((test, fold(body, dict(known))))
            if test[0] == "const":
                break
        for name in _assigned(("if", kept)):
            known.pop(name, None)
        if not kept:
            return ("block", [])
        return kept[0][1] if kept[0][0][0] == "const" else ("if", kept)
    if kind == "block":
        out: list[tuple] = []
        for part in tree[1]:
            part = fold(part, known)
            if part[0] == "set":
                known.pop(part[1], None)
                if part[2][0] == "const":
                    known[part[1]] = part[2][1]
            if part[0] == "for":
                for name in _assigned(part[3]):
                    known.pop(name, None)
            for p in part[1] if part[0] == "block" else [part]:
                if p[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + p[1])
                elif p != ("text", ""):
                    out.append(p)
        return ("block", out)
    return tree


def _assigned(tree) -> set[str]:
    """Names set anywhere below."""
    if isinstance(tree, tuple) and tree and tree[0] == "set":
        return {tree[1]}
    return set().union(*map(_assigned, tree)) if isinstance(tree, (tuple, list)) and tree else set()


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "field":
        of, field = _value(tree[1]), tree[2]

        def get(env):
            owner = of(env)
            return owner.get(field) if isinstance(owner, dict) else None

        return get
    if kind == "filter":
        f, of = FILTERS[tree[1]], _value(tree[2])
        return lambda env: f("" if (v := of(env)) is None else v)
    if kind == "not":
        of = _value(tree[1])
        return lambda env: not of(env)
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _operate(kind, a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def compiled(tree: tuple) -> Callable[[dict, bool], Pieces]:
    """A generator of (text, masked) pieces for an environment."""
    kind = tree[0]
    if kind == "text":
        text = tree[1]
        return lambda env, masked: iter(((text, masked),))
    if kind == "emit":
        of = _value(tree[1])
        return lambda env, masked: iter((("" if (v := of(env)) is None else str(v), masked),))
    if kind == "generation":
        body = compiled(tree[1])
        return lambda env, masked: body(env, True)
    if kind == "set":
        name, of = tree[1], _value(tree[2])

        def put(env, masked):
            env[name] = of(env)
            return iter(())

        return put
    if kind == "if":
        branches = [(_value(test), compiled(body)) for test, body in tree[1]]

        def choose(env, masked):
            for test, body in branches:
                if test(env):
                    return body(env, masked)
            return iter(())

        return choose
    if kind == "for":
        name, over, body = tree[1], _value(tree[2]), compiled(tree[3])

        def loop(env, masked):
            for i, item in enumerate(over(env) or ()):
                env[name], env["loop"] = item, {"index": i + 1, "first": i == 0}
                yield from body(env, masked)

        return loop
    parts = [compiled(p) for p in tree[1]]

    def block(env, masked):
        for part in parts:
            yield from part(env, masked)

    return block


def compile_template(source: str) -> Callable[..., Pieces]:
    """render(**values) -> pieces."""
    run = compiled(fold(parse(source)))
    return lambda **values: run(dict(values), False)


PART = 1 << 16  # characters of a formatted part, about
FORMATTED = "conv_id long, part long, last boolean, formatted string, mask array<struct<s:int,e:int>>"


def _turns(batches):
    for b in batches:
        for conv, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))):
            yield conv, role or "", text or ""


def _conversations(batches):
    """(id, turns): turns is an iterator to be used up before the next conversation."""
    rows = _turns(batches)
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield {"role": ahead[1], "text": ahead[2]}
                ahead = next(rows, None)

        yield conv, turns()


def _formatted(template: str):
    def run(batches):
        render = compile_template(template)
        out: list[tuple] = []
        size = 0

        def flush():
            conv, part, last, texts, masks = zip(*out)
            mask = pa.array([[{"s": s, "e": e} for s, e in m] for m in masks], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(last, pa.bool_()), pa.array(texts, pa.string()), mask], ["conv_id", "part", "last", "formatted", "mask"])

        for conv, turns in _conversations(batches):
            texts, mask, n, part = [], [], 0, 0
            for text, masked in render(turns=turns):
                if n and n + len(text) > PART:
                    out.append((conv, part, False, "".join(texts), mask))
                    size += n
                    texts, mask, n, part = [], [], 0, part + 1
                    if size > 32 * PART:
                        yield flush()
                        out, size = [], 0
                if masked and text:
                    mask.append((n, n + len(text)))
                texts.append(text)
                n += len(text)
            out.append((conv, part, True, "".join(texts), mask))
            size += n
            if size > 32 * PART or len(out) >= 5000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, last, formatted, mask: each conversation as one or more consecutive parts; mask has the character
    spans of each part that are under the loss. Parts of a conversation lie in one partition, in order."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatted(template), FORMATTED)


TURN = re.compile(r"<turn>((?:[^\\\n]|\\.)*)\n(.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    rows: list[tuple] = []
    buffer = ""
    state = None
    for b in batches:
        for conv, last, text, mask in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "last", "formatted", "mask"))):
            if state is None:
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in mask:
                said = unescape(text[m["s"] : m["e"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
            buffer += text
            at = 0
            while m := TURN.match(buffer, at):
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2] + m[3])}\n".encode())
                at = m.end()
            buffer = buffer[at:]
            if last:
                if buffer:
                    raise ValueError(f"conversation {conv} can't be read back")
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                state = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], [f.split()[0] for f in READ.split(", ")])
            rows = []


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted parts say: turns by their marks, loss by the mask."""
    return formatted.mapInArrow(_read_back, READ)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(more)))
