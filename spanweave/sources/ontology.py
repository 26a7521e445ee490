"""Ontologies from files: Turtle (and N-Triples, a part of it) or YAML and JSON; and a graph written as N-Triples.

The ontology is small and read on the driver. Terms are named by their local names. What has no
counterpart in ``spanweave.plans.ontology.Ontology`` is returned as ``ignored``, never dropped unseen.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.plans.ontology import Ontology

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|"(?:[^"\\\n]|\\.)*")(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]+))?"""
    r"""|(?P<word>@?[A-Za-z_][\w.-]*(?::[\w.-]*)?|:[\w.-]*|_:[\w.-]+)|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<mark>[\[\]();,.])""",
    re.X,
)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"


class _Reader:
    """Recursive descent over Turtle's tokens; collects (s, p, o), IRIs whole, blank nodes as _:n, texts quoted."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m.group(m.lastgroup)) for m in self._scan(text) if m.lastgroup]
        self.at, self.blank, self.prefixes, self.out = 0, 0, {}, []

    @staticmethod
    def _scan(text: str):
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle: {text[at : at + 40]!r}")
            yield m
            at = m.end()

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, mark: str | None = None):
        kind, value = self.peek()
        if kind is None or mark and value != mark:
            raise ValueError(f"expected {mark or 'a term'}, found {value!r}")
        self.at += 1
        return kind, value

    def fresh(self) -> str:
        self.blank += 1
        return f"_:b{self.blank}"

    def term(self) -> str:
        kind, value = self.take()
        if value == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.about(node)
            self.take("]")
            return node
        if value == "(":
            head = last = None
            while self.peek()[1] != ")":
                node = self.fresh()
                if last:
                    self.out.append((last, RDF + "rest", node))
                self.out.append((node, RDF + "first", self.term()))
                head, last = head or node, node
            self.take(")")
            if last:
                self.out.append((last, RDF + "rest", RDF + "nil"))
            return head or RDF + "nil"
        if kind == "iri":
            return self.prefixes.get("@base", "") + value[1:-1] if ":" not in value else value[1:-1]
        if kind == "text":
            return '"' + value.strip('"') + '"'
        if kind == "number" or value in ("true", "false"):
            return f'"{value}"'
        if value == "a":
            return RDF + "type"
        if value.startswith("_:"):
            return value
        prefix, colon, name = value.partition(":")
        if not colon or prefix not in self.prefixes:
            raise ValueError(f"unknown prefix in {value!r}")
        return self.prefixes[prefix] + name

    def about(self, subject: str) -> None:
        while True:
            verb = self.term()
            while True:
                self.out.append((subject, verb, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take(",")
            while self.peek()[1] == ";":
                self.take(";")
            if self.peek()[1] in (".", "]", None):
                return

    def read(self) -> list[tuple[str, str, str]]:
        while self.at < len(self.tokens):
            value = self.peek()[1]
            if value.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1].partition(":")[0]
                self.prefixes[name] = self.take()[1][1:-1]
            elif value.lower() in ("@base", "base"):
                self.take()
                self.prefixes["@base"] = self.take()[1][1:-1]
            else:
                subject = self.term()
                if self.peek()[1] != ".":
                    self.about(subject)
            if self.peek()[1] == ".":
                self.take(".")
        return self.out


def triples_of(text: str) -> list[tuple[str, str, str]]:
    return _Reader(text).read()


def _local(term: str) -> str:
    return re.split(r"[#/:]", term.rstrip("#/"))[-1]


_CLASS = {RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith"}
_PAIRS = {OWL + "inverseOf": "inverses", OWL + "equivalentProperty": "equivalent_properties", OWL + "propertyDisjointWith": "disjoint_properties", RDFS + "domain": "domains", RDFS + "range": "ranges", RDFS + "subPropertyOf": "subproperties"}
_KINDS = {"SymmetricProperty": "symmetric", "TransitiveProperty": "transitive", "FunctionalProperty": "functional", "InverseFunctionalProperty": "inverse_functional", "IrreflexiveProperty": "irreflexive", "AsymmetricProperty": "asymmetric"}


def from_triples(triples: list[tuple[str, str, str]]) -> tuple[Ontology, list[str]]:
    """(ontology, ignored axioms) of RDF triples."""
    of: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o in triples:
        of[s][p].append(o)
    found: dict[str, set] = defaultdict(set)
    ignored: list[str] = []

    def items(node: str) -> list[str]:
        out = []
        while node != RDF + "nil":
            out += of[node][RDF + "first"]
            node = (of[node][RDF + "rest"] or [RDF + "nil"])[0]
        return out

    def role(node: str):
        back = of[node].get(OWL + "inverseOf") if node.startswith("_:") else None
        return (_local(back[0]), True) if back else _local(node)

    def expression(node: str):
        """A class expression as ``spanweave.plans.reason`` has it; None where it has none."""
        if not node.startswith("_:"):
            return _local(node)
        told = of[node]
        for name, word in (("intersectionOf", "and"), ("unionOf", "or")):
            if told.get(OWL + name):
                parts = [expression(x) for x in items(told[OWL + name][0])]
                return None if None in parts else (word, *parts)
        if told.get(OWL + "complementOf"):
            inner = expression(told[OWL + "complementOf"][0])
            return inner and ("not", inner)
        if told.get(OWL + "onProperty"):
            prop = role(told[OWL + "onProperty"][0])
            for name, word in (("someValuesFrom", "some"), ("allValuesFrom", "only")):
                if told.get(OWL + name):
                    inner = expression(told[OWL + name][0])
                    return inner and (word, prop, inner)
            if told.get(OWL + "hasValue"):
                return ("value", prop, _local(told[OWL + "hasValue"][0]))
            for name in ("maxCardinality", "maxQualifiedCardinality"):
                if told.get(OWL + name) and told[OWL + name][0].strip('"') in ("0", "1"):
                    filler = expression(told[OWL + "onClass"][0]) if told.get(OWL + "onClass") else "Thing"
                    return filler and ("max", int(told[OWL + name][0].strip('"')), prop, filler)
        return None

    def left(e) -> bool:
        return isinstance(e, str) or e[0] in ("and", "or", "some", "value") and all(left(x) for x in (e[2:] if e[0] == "some" else () if e[0] == "value" else e[1:]))

    def right(e) -> bool:
        return isinstance(e, str) or e[0] in ("value", "max", "not", "only") or e[0] == "and" and all(map(right, e[1:]))

    def include(a, b, said: str) -> None:
        if isinstance(a, str) and isinstance(b, str):
            found["subclasses"].add((a, b))
        elif isinstance(a, str) and isinstance(b, tuple) and b[0] == "some" and isinstance(b[1], str) and isinstance(b[2], str):
            found["some"].add((a, b[1], b[2]))
        elif a and b and left(a) and right(b):
            found["rules"].add((a, b))
        else:
            ignored.append(said)

    for s, p, o in triples:
        said = f"{_local(s)} {_local(p)} {_local(o)}"
        if p == RDF + "type":
            if o in (OWL + "Class", RDFS + "Class") and not s.startswith("_:"):
                found["classes"].add(_local(s))
            elif (kind := _KINDS.get(_local(o))) and o.startswith(OWL):
                found[kind].add(_local(s))
        elif p in _CLASS:
            a, b = expression(s), expression(o)
            if p == RDFS + "subClassOf":
                include(a, b, said)
            elif p == OWL + "disjointWith":
                if isinstance(a, str) and isinstance(b, str):
                    found["disjoint"].add((a, b))
                else:
                    include(a, b and ("not", b), said)
            elif isinstance(a, str) and isinstance(b, str):
                found["equivalent"].add((a, b))
            else:
                include(a, b, said)
                include(b, a, said)
        elif p in _PAIRS and not s.startswith("_:"):
            if p in (RDFS + "domain", RDFS + "range") and o.startswith("_:"):
                ignored.append(said)
            else:
                found[_PAIRS[p]].add((_local(s), role(o) if p == OWL + "inverseOf" else _local(o)))
        elif p == OWL + "propertyChainAxiom":
            found["chains"].add((tuple(role(x) for x in items(o)), _local(s)))
        elif p in (OWL + "hasKey", OWL + "oneOf", OWL + "disjointUnionOf"):
            ignored.append(said)
    found["classes"] |= {c for pair in found["subclasses"] | found["disjoint"] | found["equivalent"] for c in pair}
    return Ontology(**{k: frozenset(v) for k, v in found.items()}), ignored


def load(*paths: str) -> tuple[Ontology, str, list[str]]:
    """(ontology, version, ignored) of files merged in order; the version is a digest of their bytes."""
    merged, ignored, digest = Ontology(), [], hashlib.sha256()
    for path in paths:
        with open(path, "rb") as f:
            raw = f.read()
        digest.update(raw)
        text = raw.decode()
        if path.endswith((".json", ".yaml", ".yml")):
            if path.endswith(".json"):
                told = json.loads(text)
            else:
                import yaml  # only where a YAML file is read

                told = yaml.safe_load(text)
            unknown = set(told) - set(Ontology.__dataclass_fields__)
            if unknown:
                raise ValueError(f"{path}: unknown axioms {sorted(unknown)}")
            freeze = lambda x: tuple(map(freeze, x)) if isinstance(x, list) else x
            more, left = {k: set(map(freeze, v)) for k, v in told.items()}, []
        else:
            onto, left = from_triples(triples_of(text))
            more = {k: getattr(onto, k) for k in Ontology.__dataclass_fields__}
        merged, ignored = merged.with_axioms(**more), ignored + left
    return merged, digest.hexdigest()[:12], ignored


def expand_curie(name: str, prefixes: dict[str, str]) -> str:
    """``prefix:local`` as an IRI; other names as they are."""
    prefix, colon, local = name.partition(":")
    return prefixes[prefix] + local if colon and prefix in prefixes and not local.startswith("//") else name


def graph_triples(nodes: DataFrame, links: DataFrame, base: str = "urn:graph:") -> DataFrame:
    """Lines of N-Triples of a graph, evidence included: types, fields, links, and a statement a quoted link.

    Names are percent-encoded into IRIs; texts have quotes, backslashes and line ends escaped.
    """
    iri = lambda c: F.concat(F.lit("<" + base), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit(">"))

    def text(c):
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.concat(F.lit('"'), c, F.lit('"'))

    line = lambda d, s, p, o: d.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("line"))
    known = lambda ns, n: F.lit(f"<{ns}{n}>")
    subject = iri(F.col("id"))
    out = line(nodes, subject, known(RDF, "type"), iri(F.col("type")))
    out = out.union(line(nodes.select("id", F.explode("fields").alias("k", "v")).where("v IS NOT NULL"), subject, iri(F.col("k")), text(F.col("v"))))
    out = out.union(line(links, iri(F.col("src")), iri(F.col("predicate")), iri(F.col("dst"))))
    for part, c in (("subject", "src"), ("predicate", "predicate"), ("object", "dst")):
        out = out.union(line(links, subject, known(RDF, part), iri(F.col(c))))
    if "spans" in links.columns:
        quotes = links.select("id", F.explode("spans").alias("s"))
        out = out.union(line(quotes, subject, known("http://www.w3.org/ns/oa#", "exact"), text(F.col("s.text"))))
    return out
