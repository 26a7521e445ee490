"""A small ontology on the driver: closures that queries widen by, profile checks, EL classification."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

Role = tuple[str, bool]
"""A property and whether it is read backwards."""


@dataclass(frozen=True)
class Ontology:
    """Told axioms. ``some``: (class, property, filler): each of the class has such a link to a filler."""

    classes: frozenset[str] = frozenset()
    subclasses: frozenset[tuple[str, str]] = frozenset()
    subproperties: frozenset[tuple[str, str]] = frozenset()
    inverses: frozenset[tuple[str, str]] = frozenset()
    symmetric: frozenset[str] = frozenset()
    transitive: frozenset[str] = frozenset()
    functional: frozenset[str] = frozenset()
    irreflexive: frozenset[str] = frozenset()
    asymmetric: frozenset[str] = frozenset()
    chains: frozenset[tuple[tuple[str, ...], str]] = frozenset()
    domains: frozenset[tuple[str, str]] = frozenset()
    ranges: frozenset[tuple[str, str]] = frozenset()
    disjoint: frozenset[tuple[str, str]] = frozenset()
    some: frozenset[tuple[str, str, str]] = frozenset()
    both: frozenset[tuple[str, str, str]] = field(default=frozenset())  # A and B under C
    fields: frozenset[tuple[str, str]] = frozenset()
    """(class, field): what a class's nodes may record, told; classes below have it too."""
    inverse_functional: frozenset[str] = frozenset()
    equivalent: frozenset[tuple[str, str]] = frozenset()
    equivalent_properties: frozenset[tuple[str, str]] = frozenset()
    disjoint_properties: frozenset[tuple[str, str]] = frozenset()
    rules: frozenset[tuple[tuple, tuple]] = frozenset()
    """(left, right) inclusions of class expressions; see ``spanweave.plans.reason``."""

    def declared_fields(self, name: str) -> set[str]:
        above = self.superclasses_of(name)
        return {f for c, f in self.fields if c in above}

    def properties(self) -> set[str]:
        """All property names that an axiom mentions."""
        pairs = self.subproperties | self.inverses | self.equivalent_properties | self.disjoint_properties
        ends = {p for p, _ in self.domains | self.ranges}
        kinds = self.symmetric | self.transitive | self.functional | self.irreflexive | self.asymmetric | self.inverse_functional
        return {p for pair in pairs for p in pair} | ends | kinds | {p for c, r in self.chains for p in (*c, r)} | {p for _, p, _ in self.some}

    def with_axioms(self, **more) -> "Ontology":
        """The ontology and more axioms of the named kinds."""
        return replace(self, **{k: getattr(self, k) | frozenset(v) for k, v in more.items()})

    def subclasses_of(self, name: str) -> set[str]:
        """The class and all told below it."""
        return _below({name}, {(sup, sub) for sub, sup in self._under()})

    def superclasses_of(self, name: str) -> set[str]:
        return _below({name}, self._under())

    def _under(self) -> set[tuple[str, str]]:
        """(class, class above it): told, and equivalent ones both ways."""
        return {*self.subclasses, *self.equivalent, *((b, a) for a, b in self.equivalent)}

    def role_steps(self) -> set[tuple[Role, Role]]:
        """(role, role it is under): one step of the property hierarchy, with directions."""
        out: set[tuple[Role, Role]] = set()
        equal = {*self.equivalent_properties, *((b, a) for a, b in self.equivalent_properties)}
        for sub, sup in self.subproperties | equal:
            out |= {((sub, False), (sup, False)), ((sub, True), (sup, True))}
        for a, b in self.inverses:
            for x, y in ((a, b), (b, a)):
                out |= {((x, False), (y, True)), ((x, True), (y, False))}
        for p in self.symmetric:
            out |= {((p, False), (p, True)), ((p, True), (p, False))}
        return out

    def ways(self, name: str, backward: bool = False) -> set[Role]:
        """All properties and directions whose links count as the named property's."""
        return _below({(name, backward)}, {(sup, sub) for sub, sup in self.role_steps()})

    def widen(self, follow: list[str]) -> list[str]:
        """Property names to follow, with all that lie under them."""
        return sorted({p for f in follow for p, _ in self.ways(f)})

    def are_disjoint(self, a: str, b: str) -> bool:
        """Told, or inherited from classes above."""
        up, down = self.superclasses_of(a), self.superclasses_of(b)
        return any((x, y) in self.disjoint or (y, x) in self.disjoint for x in up for y in down)

    def outside(self, profile: str) -> list[str]:
        """Kinds of axioms used that a profile (RDFS, EL, QL, RL) does not have."""
        allowed = {
            "RDFS": {"subclasses", "subproperties", "domains", "ranges"},
            "EL": {"equivalent", "equivalent_properties", "subclasses", "subproperties", "domains", "ranges", "transitive", "chains", "disjoint", "some", "both"},
            "QL": {"equivalent", "equivalent_properties", "disjoint_properties", "subclasses", "subproperties", "domains", "ranges", "inverses", "symmetric", "disjoint", "some", "asymmetric", "irreflexive"},
            "RL": {"equivalent", "equivalent_properties", "disjoint_properties", "inverse_functional", "rules", "subclasses", "subproperties", "domains", "ranges", "inverses", "symmetric", "transitive", "functional", "irreflexive", "asymmetric", "chains", "disjoint", "both"},
        }[profile]
        return sorted(k for k, v in self.__dict__.items() if k not in ("classes", "fields") and v and k not in allowed)

    def classify(self) -> tuple[dict[str, set[str]], set[str]]:
        """EL completion: (superclasses of each class, unsatisfiable classes)."""
        names = set(self.classes) | {c for pair in self.subclasses | self.disjoint for c in pair} | {c for pair in self.equivalent for c in pair} | {c for a, _, b in self.some for c in (a, b)} | {c for t in self.both for c in t}
        sups = {n: {n} for n in names}
        edges: set[tuple[str, str, str]] = set()
        bottom: set[str] = set()
        domains = [(p, c) for p, c in self.domains]
        under = self._under()
        while True:
            before = sum(map(len, sups.values())), len(edges), len(bottom)
            for n, s in sups.items():
                for sub, sup in under:
                    if sub in s:
                        s.add(sup)
                for a, b, c in self.both:
                    if a in s and b in s:
                        s.add(c)
                edges |= {(n, p, f) for c, p, f in self.some if c in s}
                if any(a in s and b in s for a, b in self.disjoint):
                    bottom.add(n)
            for sub, sup in self.subproperties:
                edges |= {(a, sup, b) for a, p, b in edges if p == sub}
            for p in self.transitive:
                edges |= {(a, p, d) for a, q, b in edges if q == p for c, r, d in edges if r == p and b == c}
            for (p, q), r in [(c, r) for c, r in self.chains if len(c) == 2]:
                edges |= {(a, r, d) for a, x, b in edges if x == p for c, y, d in edges if y == q and b == c}
            for a, p, f in edges:
                sups[a] |= {c for q, c in domains if q == p}
                if f in bottom or any(self.are_disjoint(f, c) for q, c in self.ranges if q == p):
                    bottom.add(a)
            bottom |= {n for n, s in sups.items() if s & bottom}
            if before == (sum(map(len, sups.values())), len(edges), len(bottom)):
                return sups, bottom


def _below(start: set, steps: set) -> set:
    """All that steps lead to."""
    out, new = set(start), set(start)
    while new:
        new = {b for a, b in steps if a in new} - out
        out |= new
    return out


def inspect(onto: Ontology, budget: int = 2000, profile: str = "") -> tuple[list[tuple[str, str, str]], list[str]]:
    """The formal gate: (problems as (kind, term, detail), what was left unchecked).

    Beyond ``budget`` classes nothing is looked for, and all is unchecked. cycle: a class below itself by
    told axioms; unknown: a parent, domain or range that is no class; disjoint: a class disjoint with
    itself or one above it; inverse: an inverse whose domain and range do not cross over; unsatisfiable:
    the EL engine finds that nothing can be one; outside-profile: axioms that ``profile`` does not have.
    """
    if len(onto.classes) > budget:
        return [], ["hierarchy", "disjointness", "relations", "inverses", "engine"]
    found: list[tuple[str, str, str]] = []
    for name in sorted(onto.classes):
        above = _below({b for a, b in onto.subclasses if a == name}, set(onto.subclasses))
        if name in above:
            found.append(("cycle", name, "lies below itself"))
        if any({a, b} <= above | {name} for a, b in onto.disjoint):
            found.append(("disjoint", name, "lies under two disjoint classes"))
    for kind, pairs in (("parent", onto.subclasses), ("domain", onto.domains), ("range", onto.ranges)):
        found += [("unknown", x, f"{kind} {y}") for x, y in sorted(pairs) if y not in onto.classes and y != "Thing"]
    of = lambda axioms, p: {c for q, c in axioms if q == p}
    for p, q in sorted(onto.inverses):
        for x, y in ((p, q), (q, p)):
            near, far = of(onto.domains, x), of(onto.ranges, y)
            if near and far and not any(onto.subclasses_of(a) & onto.subclasses_of(b) for a in near for b in far):
                found.append(("inverse", x, f"its domain and the range of {y} have no class in common"))
    named = {term for _, term, _ in found}
    found += [("unsatisfiable", n, "the EL engine derives that nothing can be one") for n in sorted(onto.classify()[1]) if n not in named]
    if profile:
        found += [("outside-profile", profile, kind) for kind in onto.outside(profile)]
    return found, []
