"""Networks and questions as text: reader and printers.

    dpn { controls {t:"name"} stacks {..} actions {..} locks {..}   initial (c, s)
          rules { (c,s)--a-->(c1,s1)          base      (c,s)--a-->(c1)               pop
                  (c,s)--a-->(c1,s1:>c2,s2)   spawn     (c,s)--a-->(c1,callee,ret)    push
                  (c,s)--a-lock-->(c1,callee,ret)       push under a lock } }
    check for conflict nolocks between {s ..} and {s ..}

Controls may be left out everywhere (control 0 then).  Commas in lists are optional, undeclared
terms name themselves, ``//`` and ``/* */`` are comments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RULES = "qid string, kind string, g string, s string, g1 string, s1 string, g2 string, s2 string, lock bigint, bad bigint, action string"
_SKIP = re.compile(r"\s+|//[^\n]*|/\*.*?\*/", re.S)
_TOKEN = re.compile(r'-->|--|:>|"[^"]*"|[A-Za-z0-9_]+|[{}(),:-]')
_SECTIONS = ("controls", "stacks", "actions", "locks")


@dataclass
class Rule:
    kind: str
    g: str
    s: str
    action: str
    g1: str
    s1: str | None = None
    g2: str | None = None
    s2: str | None = None
    lock: str | None = None


@dataclass
class Network:
    initial: tuple[str, str]
    rules: list[Rule]
    names: dict[str, dict[str, str]] = field(default_factory=dict)

    def locks(self) -> list[str]:
        """Locks of the rules in the order of their terms; the place is a lock's number."""
        return sorted({r.lock for r in self.rules if r.lock is not None})

    def symbols(self) -> set[str]:
        found = {x for r in self.rules for x in (r.s, r.s1, r.s2) if x is not None}
        return found | {self.initial[1]}


@dataclass
class Task:
    network: Network
    first: list[str]
    second: list[str]
    with_locks: bool = True

    def check(self) -> None:
        """Both sets hold symbols of the network, and at least one."""
        for name, wanted in (("first", self.first), ("second", self.second)):
            missing = sorted(set(wanted) - self.network.symbols())
            if not wanted or missing:
                raise ValueError(f"the {name} set is empty" if not wanted else f"not in the network: {missing}")


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            if m := _SKIP.match(text, at):
                at = m.end()
            elif m := _TOKEN.match(text, at):
                self.tokens.append(m.group())
                at = m.end()
            else:
                line = text.count("\n", 0, at) + 1
                raise ValueError(f"line {line}: unexpected {text[at]!r}")
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found is None or (wanted and found not in wanted):
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {found!r} at token {self.at}")
        self.at += 1
        return found

    def skip(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def term(self) -> str:
        found = self.take()
        if not re.fullmatch(r"\w+", found):
            raise ValueError(f"expected a term, found {found!r} at token {self.at - 1}")
        return found

    def terms(self) -> list[str]:
        out = []
        self.take("{")
        while not self.skip("}"):
            out.append(self.term())
            self.skip(",")
        return out

    def names(self) -> dict[str, str]:
        out = {}
        self.take("{")
        while not self.skip("}"):
            term = self.term()
            out[term] = self.take().strip('"') if self.skip(":") else term
            self.skip(",")
        return out

    def place(self) -> tuple[list[str], list[str] | None]:
        """Terms in brackets, and those after ``:>``."""
        self.take("(")
        out: list[str] = []
        started = None
        while not self.skip(")"):
            if self.skip(":>"):
                started = []
                continue
            (out if started is None else started).append(self.term())
            self.skip(",")
        return out, started

    def rule(self) -> Rule:
        left, _ = self.place()
        self.take("--")
        action, lock = self.term(), None
        if self.skip("-"):
            lock = self.term()
        self.take("-->")
        right, started = self.place()
        if len(left) == 1:  # without controls
            left, right = ["0", *left], ["0", *right]
            started = None if started is None else ["0", *started]
        g, s = left
        if started is not None:
            return Rule("spawn", g, s, action, *right, *started)
        if len(right) == 1:
            return Rule("pop", g, s, action, right[0])
        if len(right) == 2:
            return Rule("base", g, s, action, *right)
        g1, callee, ret = right
        return Rule("push", g, s, action, g1, callee, None, ret, lock)

    def network(self) -> Network:
        self.take("dpn")
        self.take("{")
        names: dict[str, dict[str, str]] = {}
        initial, rules = None, []
        while not self.skip("}"):
            word = self.take(*_SECTIONS, "initial", "rules")
            if word == "initial":
                found, _ = self.place()
                initial = ("0", found[0]) if len(found) == 1 else (found[0], found[1])
            elif word == "rules":
                self.take("{")
                while not self.skip("}"):
                    rules.append(self.rule())
                    self.skip(",")
            else:
                names[word] = self.names()
        if initial is None:
            raise ValueError("no initial symbol")
        return Network(initial, rules, names)


def parse(text: str) -> Network:
    reader = _Reader(text)
    found = reader.network()
    if reader.peek() is not None:
        raise ValueError(f"unexpected {reader.peek()!r} after the network")
    return found


def parse_task(text: str) -> Task:
    reader = _Reader(text)
    network = reader.network()
    reader.skip("check")
    reader.skip("for")
    reader.take("conflict")
    with_locks = not reader.skip("nolocks")
    reader.skip("between")
    first = reader.terms()
    reader.skip("and")
    task = Task(network, first, reader.terms(), with_locks)
    task.check()
    return task


def parse_any(text: str) -> Network | Task:
    """A network, or a question if one follows it."""
    reader = _Reader(text)
    network = reader.network()
    return network if reader.peek() is None else parse_task(text)


def print_network(network: Network, numbered: bool = False) -> str:
    """The text of a network, names included; with ``numbered`` terms are replaced by their place in term
    order and named by what they were called."""
    controls = sorted({x for r in network.rules for x in (r.g, r.g1, r.g2) if x is not None} | {network.initial[0]})
    kinds = {"c": controls, "s": sorted(network.symbols()), "a": sorted({r.action for r in network.rules}), "l": network.locks()}
    places = {k: {x: str(i) for i, x in enumerate(v)} for k, v in kinds.items()}
    t = (lambda k, x: places[k][x]) if numbered else (lambda k, x: x)
    lines = []
    for r in network.rules:
        arrow = f"--{t('a', r.action)}{'-' + t('l', r.lock) if r.lock else ''}-->"
        right = [t("c", r.g1)] + ([t("s", r.s1)] if r.s1 is not None else []) + ([t("s", r.s2)] if r.kind == "push" else [])
        started = f":>{t('c', r.g2)},{t('s', r.s2)}" if r.kind == "spawn" else ""
        lines.append(f"    ({t('c', r.g)},{t('s', r.s)}){arrow}({','.join(right)}{started})")
    start = f"initial({t('c', network.initial[0])},{t('s', network.initial[1])})"
    sections = []
    for (kind, terms), section in zip(kinds.items(), _SECTIONS, strict=True):
        names = network.names.get(section, {})
        entries = {x: names.get(x, x) for x in ([*terms] if numbered else [*terms, *(n for n in names if n not in terms)])}
        if numbered or names:
            sections.append(f"  {section}{{" + ", ".join(f'{t(kind, x)}:"{name}"' for x, name in entries.items()) + "}")
    return "\n".join(["dpn{", *sections, f"  {start}", "  rules{", *lines, "  }", "}"])


def tables(spark: SparkSession, networks: dict[str, Network], forbidden: dict[str, list[set[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, initial) of networks by question; ``forbidden``: actions by stage."""
    rows = []
    for qid, n in networks.items():
        number = {x: i for i, x in enumerate(n.locks())}
        stages = (forbidden or {}).get(qid, [])
        for r in n.rules:
            bad = sum(1 << i for i, actions in enumerate(stages) if r.kind == "base" and r.action in actions)
            rows.append((qid, r.kind, r.g, r.s, r.g1, r.s1, r.g2, r.s2, number.get(r.lock), bad, r.action))
    initial = [(qid, *n.initial) for qid, n in networks.items()]
    return spark.createDataFrame(rows, RULES), spark.createDataFrame(initial, "qid string, g string, s string")


def sets(spark: SparkSession, members: dict[str, list[list[str]]]) -> DataFrame:
    """The sets of every question, numbered from 0."""
    return spark.createDataFrame([(q, i, s) for q, m in members.items() for i, x in enumerate(m) for s in x], "qid string, i int, s string")


def conflicts(spark: SparkSession, tasks: dict[str, Task]) -> dict[str, bool]:
    """Answers of parsed questions; those without locks are taken without lock columns."""
    from weft.operators import emptiness

    out: dict[str, bool] = {}
    for with_locks in (False, True):
        some = {q: t for q, t in tasks.items() if (t.with_locks and bool(t.network.locks())) == with_locks}
        if some:
            rules, initial = tables(spark, {q: t.network for q, t in some.items()})
            found = emptiness.two_sets(rules, initial, sets(spark, {q: [t.first, t.second] for q, t in some.items()}), with_locks)
            out |= {r.qid: r.reached for r in found.collect()}  # one row for each question
    return out
