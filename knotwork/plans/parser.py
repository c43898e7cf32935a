"""Text to syntax trees: a tokenizer and a recursive-descent parser.

Keywords are case-insensitive and may be used as names. Comments are // to the end of the line and /* */.
"""

from __future__ import annotations

import re

from knotwork.errors import QueryError
from knotwork.plans import syntax as s

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>\d+)
      | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
      | (?P<name>[^\W\d]\w*|`[^`]+`)
      | (?P<op>\$\$|\$\^|\$|<=|>=|==|!=|<>|=~|->|<-|\.\.|[-+*/%=<>()\[\]{},:;.|@!])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
TYPES = ("BOOL", "INT8", "INT16", "INT32", "INT64", "INT", "FLOAT", "DOUBLE", "STRING", "TIMESTAMP", "DATE", "TIME", "DATETIME")
COMPARISONS = ("==", "=", "!=", "<>", "<=", ">=", "<", ">", "=~")


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "string":
            found.append((kind, re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), m[0][1:-1], flags=re.S)))
        elif kind == "name":
            found.append((kind, m[0].strip("`")))
        elif kind != "space":
            found.append((kind, m[0]))
    return [*found, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.hidden = tokens(text), 0, 0

    # --- tokens ---

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted}, found {self.text or 'the end'!r}")

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        for k, w in enumerate(words):
            if self.at + ahead + k >= len(self.tokens):
                return False
            kind, text = self.tokens[self.at + ahead + k]
            if kind != "name" or text.upper() != w:
                return False
        return True

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.text in ops

    def op(self, *ops: str) -> str | None:
        if self.is_op(*ops):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need_op(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    def name(self) -> str:
        if self.kind != "name":
            self.fail("a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def integer(self) -> int:
        sign = -1 if self.op("-") else 1
        if self.kind != "int":
            self.fail("an integer")
        self.at += 1
        return sign * int(self.tokens[self.at - 1][1])

    def number(self) -> float:
        sign = -1 if self.op("-") else 1
        if self.kind not in ("int", "float"):
            self.fail("a number")
        self.at += 1
        return sign * float(self.tokens[self.at - 1][1])

    def many(self, one, sep: str = ",") -> tuple:
        found = [one()]
        while self.op(sep):
            found.append(one())
        return tuple(found)

    # --- scripts ---

    def script(self) -> s.Script:
        clauses = []
        while self.kind != "end":
            if self.op(";"):
                continue
            var = None
            if self.is_op("$") and self.tokens[self.at + 2][1] == "=":
                self.op("$")
                var = self.name()
                self.op("=")
            clauses.append((var, self.statement()))
            if self.kind != "end" and not self.is_op(";"):
                self.fail("';' or the end")
        if not clauses:
            raise QueryError("there is no statement")
        return s.Script(tuple(clauses))

    def statement(self):
        first = self.text.upper() if self.kind == "name" else ""
        parse = getattr(self, f"do_{first.lower()}", None)
        if parse is None:
            self.fail("a statement")
        self.at += 1
        return parse()

    def do_use(self):
        return s.Use(self.name())

    def do_explain(self):
        return s.Explain(self.statement())

    def do_profile(self):
        return s.Explain(self.statement(), profile=True)

    def do_balance(self):
        while self.kind != "end" and not self.is_op(";"):
            self.at += 1
        return s.Unsupported("BALANCE")

    def do_check(self):
        return s.Check(self.name().upper())

    def do_repair(self):
        self.need("INFERENCE")
        return s.Check("REPAIR")

    def do_rebuild(self):
        kind = self.name().upper()
        self.need("INDEX")
        name = self.name() if self.kind == "name" else None
        return s.Show(f"{kind} INDEX STATUS", name)

    # --- MATCH ---

    def do_match(self):
        patterns, optional, where = self.many(self.pattern), [], None
        while True:
            if self.word("OPTIONAL", "MATCH"):
                optional += self.many(self.pattern)
            elif where is None and self.word("WHERE"):
                where = self.expression()
            else:
                break
        items, group, order, limit, offset = (), None, [], None, 0
        if self.word("RETURN"):
            items = self.many(self.item)
        if self.word("GROUP", "BY"):
            group = self.many(self.expression)
        if self.word("ORDER", "BY"):
            order = self.many(self.order_key)
        limit, offset = self.window()
        return s.Match(patterns, tuple(optional), where, items, group, tuple(order), limit, offset)

    def window(self):
        limit, offset = None, 0
        if self.word("LIMIT"):
            limit = self.integer()
        if self.word("OFFSET") or self.word("SKIP"):
            offset = self.integer()
        return limit, offset

    def order_key(self):
        e = self.expression()
        down = self.word("DESC") or self.word("DESCENDING")
        if not down:
            self.word("ASC") or self.word("ASCENDING")
        return e, bool(down)

    def item(self):
        e = self.expression()
        return s.Item(e, self.name() if self.word("AS") else None)

    def anonymous(self) -> str:
        self.hidden += 1
        return f"__anon{self.hidden}"

    def pattern(self):
        nodes, edges = [self.node()], []
        while self.is_op("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return s.Pattern(tuple(nodes), tuple(edges))

    def node(self):
        self.need_op("(")
        var = self.name() if self.kind == "name" else self.anonymous()
        labels, seps = [], set()
        if self.op(":"):
            labels.append(self.name())
            while sep := self.op(":", "|"):
                seps.add(sep)
                labels.append(self.name())
        if len(seps) > 1:
            raise QueryError("labels are joined by ':' or by '|', not by both")
        props = self.property_map()
        self.need_op(")")
        return s.NodePat(var, tuple(labels), "|" in seps, props)

    def property_map(self):
        if not self.op("{"):
            return ()
        found = []
        while not self.op("}"):
            if found:
                self.need_op(",")
            name = self.name()
            self.need_op(":")
            found.append((name, self.literal()))
        return tuple(found)

    def literal(self):
        e = self.unary()
        if isinstance(e, s.ListOf) and all(isinstance(x, s.Lit) for x in e.items):
            return [x.value for x in e.items]
        if not isinstance(e, s.Lit):
            raise QueryError("only literals are allowed here")
        return e.value

    def edge(self):
        incoming = bool(self.op("<-"))
        if not incoming:
            self.need_op("-")
        var, named, types, span, props = self.anonymous(), False, [], None, ()
        if self.op("["):
            if self.kind == "name":
                var, named = self.name(), True
            if self.op(":"):
                types.append(self.name())
                while self.op(":", "|"):
                    types.append(self.name())
            if self.op("*"):
                # only *m..n makes a range; * and *n stand for one hop
                if self.kind == "int":
                    low = self.integer()
                    if self.op(".."):
                        span = (low, self.integer())
            props = self.property_map()
            self.need_op("]")
        outgoing = bool(self.op("->"))
        if not outgoing:
            self.need_op("-")
        if incoming and outgoing:
            raise QueryError("an edge points one way or neither")
        return s.EdgePat(var, tuple(types), "in" if incoming else "out" if outgoing else "both", span, props, named)

    # --- GO, FETCH, LOOKUP, FIND, RECOMMEND, WHY ---

    def vids(self):
        if self.op("$"):
            var = self.name()
            self.need_op(".")
            return s.VarCol(var, self.name())
        return tuple(self.many(self.vid))

    def vid(self):
        if self.kind == "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return self.integer()

    def over(self):
        return None if self.op("*") else self.many(self.name)

    def do_go(self):
        low = high = 1
        if self.kind == "int":
            low = high = self.integer()
            if self.op(".."):
                high = self.integer()
            self.word("STEPS") or self.need("STEP")
        self.need("FROM")
        start = self.vids()
        self.need("OVER")
        over = self.over()
        direction = "in" if self.word("REVERSELY") else "both" if self.word("BIDIRECT") else "out"
        where = self.expression() if self.word("WHERE") else None
        items = self.many(self.item) if self.word("YIELD") else ()
        return s.Go(low, high, start, over, direction, where, items)

    def do_fetch(self):
        self.need("PROP", "ON")
        names = self.over()
        if self.is_op("$"):
            refs, edge = self.vids(), False
        else:
            refs = self.many(self.reference)
            edge = isinstance(refs[0], tuple)
            if any(isinstance(r, tuple) != edge for r in refs):
                raise QueryError("vertices and edges cannot be fetched together")
        as_of = self.integer() if self.word("AS", "OF") else None
        if self.word("YIELD"):
            self.many(self.item)
        return s.Fetch(names, refs, edge, as_of)

    def reference(self):
        src = self.vid()
        if not self.op("->"):
            return src
        dst = self.vid()
        return src, dst, self.integer() if self.op("@") else None

    def do_lookup(self):
        self.need("ON")
        edge = self.is_word("EDGE") and self.tokens[self.at + 1][0] == "name" and not self.is_word("WHERE", ahead=1)
        if edge:
            self.word("EDGE")
        name = self.name()
        where = self.expression() if self.word("WHERE") else None
        if self.word("YIELD"):
            self.many(self.item)
        return s.Lookup(name, where, edge, *self.window())

    def do_find(self):
        every = self.word("ALL")
        shortest = self.word("SHORTEST")
        self.word("PATHS") or self.need("PATH")
        self.need("FROM")
        source = self.vid()
        self.need("TO")
        target = self.vid()
        self.need("OVER")
        over = self.over()
        if over is not None and len(over) > 1:
            raise QueryError("FIND takes one edge type or *")
        both = weight = upto = None
        while True:
            if self.word("BIDIRECT"):
                both = True
            elif self.word("WEIGHT", "BY"):
                weight = self.name()
            elif self.word("UPTO"):
                upto = self.integer()
                self.word("STEPS") or self.word("STEP")
            else:
                break
        if self.is_word("WHERE") or self.is_word("YIELD"):
            raise QueryError("FIND takes no WHERE or YIELD")
        return s.Find(shortest, every, source, target, over[0] if over else None, bool(both), weight, upto)

    def do_recommend(self):
        self.need("SIMILAR", "TO")
        seed = self.integer()
        kw = {}
        if self.word("BY", "EMBEDDING"):
            kw["embedding"] = self.name()
        elif self.word("BLEND"):
            self.need("EMBEDDING")
            kw |= {"embedding": self.name(), "embedding_weight": self.number(), "structural": True}
            self.need("OVER")
            kw |= {"over": self.over(), "over_weight": self.number()}
        else:
            self.need("OVER")
            kw |= {"over": self.over(), "structural": True}
        if self.word("WHERE"):
            kw["where"] = self.expression()
        if self.word("LIMIT"):
            kw["limit"] = self.integer()
            if kw["limit"] <= 0:
                raise QueryError("LIMIT must be positive")
        return s.Recommend(seed, **kw)

    def do_why(self):
        src = self.integer()
        self.need_op("->")
        dst = self.integer()
        self.need("OVER")
        return s.Why(src, dst, self.name())

    # --- INSERT, UPDATE, DELETE ---

    def names_in_parens(self):
        self.need_op("(")
        found = []
        while not self.op(")"):
            if found:
                self.need_op(",")
            found.append(self.name())
        return tuple(found)

    def values(self):
        self.need_op("(")
        found = []
        while not self.op(")"):
            if found:
                self.need_op(",")
            found.append(self.value())
        return tuple(found)

    def value(self):
        """A literal; a bare name is a string."""
        if self.kind == "name" and not self.is_word("NULL") and not self.is_word("TRUE") and not self.is_word("FALSE"):
            return self.name()
        return self.literal()

    def do_insert(self):
        if self.word("VERTEX"):
            tags = self.many(lambda: (self.name(), self.names_in_parens()))
            self.need("VALUES")

            def row():
                vid = self.vid()
                self.need_op(":")
                return vid, self.values()

            return s.InsertVertex(tags, self.many(row))
        self.need("EDGE")
        name, props = self.name(), self.names_in_parens()
        self.need("VALUES")

        def edge():
            src = self.vid()
            self.need_op("->")
            dst = self.vid()
            rank = self.integer() if self.op("@") else 0
            self.need_op(":")
            return src, dst, rank, self.values()

        return s.InsertEdge(name, props, self.many(edge))

    def do_update(self):
        edge = self.word("EDGE")
        if not edge:
            self.need("VERTEX")
        self.need("ON")
        name = self.name()
        ref = self.reference()
        self.need("SET")

        def change():
            field = self.name()
            self.need_op("=")
            return field, self.value()

        changes = self.many(change)
        when = self.expression() if self.word("WHEN") else None
        if self.word("YIELD"):
            self.many(self.item)
        return s.Update(name, ref, edge, changes, when)

    def do_delete(self):
        if self.word("VERTEX"):
            vids = self.many(self.vid)
            return s.DeleteVertex(vids, self.expression() if self.word("WHERE") else None)
        self.need("EDGE")
        name = self.name()
        refs = self.many(self.reference)
        if self.word("WHERE"):
            self.expression()
        return s.DeleteEdge(name, refs)

    # --- schema ---

    def quiet(self, *words: str) -> bool:
        return self.word(*words)

    def field(self):
        name, kind = self.name(), self.name().upper()
        if kind not in TYPES:
            raise QueryError(f"unknown type {kind}")
        null, default = True, None
        while True:
            if self.word("NOT", "NULL"):
                null = False
            elif self.word("NULL"):
                null = True
            elif self.word("DEFAULT"):
                default = self.literal()
            else:
                return name, kind, null, default

    def fields(self):
        self.need_op("(")
        found = []
        while not self.op(")"):
            if found:
                self.need_op(",")
            found.append(self.field())
        return tuple(found)

    def do_create(self):
        kind = self.name().lower()
        if kind in ("tag", "edge") and self.word("INDEX"):
            quiet = self.quiet("IF", "NOT", "EXISTS")
            name = self.name()
            self.need("ON")
            return s.Create(f"{kind} index", name, quiet=quiet, options={"on": self.name(), "fields": self.names_in_parens()})
        quiet = self.quiet("IF", "NOT", "EXISTS")
        if kind == "space":
            return self.space(self.name(), quiet)
        if kind == "shape":
            name = self.name()
            self.need("ON")
            target = self.name()
            self.need_op("(")
            return s.Create("shape", name, self.many(self.shape_rule), quiet, {"on": target} | ({} if self.op(")") else self.fail("')'")))
        if kind not in ("tag", "edge", "class"):
            return s.Unsupported(f"CREATE {kind.upper()}")
        name = self.name()
        fields = self.fields() if self.is_op("(") else ()
        options: dict = {}
        single = {"INVERSE OF": "inverse", "SUBPROPERTY OF": "sub", "DOMAIN": "domain", "RANGE": "range"}
        while self.kind == "name":
            if self.word("TRANSITIVE"):
                options["transitive"] = True
            elif self.word("SYMMETRIC"):
                options["symmetric"] = True
            elif self.word("CHAIN"):
                options["chain"] = (self.name(), self.op(",") and self.name())
            elif self.word("SUBCLASS", "OF"):
                options["parents"] = self.many(self.name)
            elif self.word("EQUIVALENT", "TO"):
                options["equivalent"] = self.many(self.name)
            elif self.word("DISJOINT", "WITH"):
                options["disjoint"] = self.many(self.name)
            else:
                clause = next((c for c in single if self.word(*c.split())), None)
                if clause is None:
                    self.fail("a clause or the end")
                options[single[clause]] = self.name()
        return s.Create(kind, name, fields, quiet, options)

    def shape_rule(self):
        """(property, "check", expression), or (property, type or None, required)."""
        prop = self.name()
        if self.word("CHECK"):
            return prop, "check", self.expression()
        kind = self.name().upper() if self.kind == "name" and self.text.upper() in TYPES else None
        return prop, kind, bool(self.word("REQUIRED"))

    def space(self, name: str, quiet: bool):
        options: dict = {}
        if self.op("("):
            while not self.op(")"):
                if options:
                    self.need_op(",")
                key = self.name().lower()
                self.need_op("=")
                if self.kind == "int":
                    options[key] = self.integer()
                else:
                    options[key] = self.name().upper()
                    if self.op("("):
                        options["vid_length"] = self.integer()
                        self.need_op(")")
        if self.word("PARTITION", "BY"):
            options["partition_by"] = self.name().upper()
            if options["partition_by"] == "RANGE":
                self.need_op("(")
                options["boundaries"] = self.many(self.integer)
                self.need_op(")")
        return s.Create("space", name, (), quiet, options)

    def do_alter(self):
        kind = self.name().lower()
        if kind not in ("tag", "edge"):
            return s.Unsupported(f"ALTER {kind.upper()}")
        name, action = self.name(), self.name().upper()
        if action not in ("ADD", "DROP", "CHANGE"):
            raise QueryError("ALTER takes ADD, DROP or CHANGE")
        return s.Alter(kind, name, action, self.names_in_parens() if action == "DROP" else self.fields())

    def do_drop(self):
        if self.word("INDEX"):
            kind = f"{self.name().lower()} index"
        else:
            kind = self.name().lower()
            if kind in ("tag", "edge") and self.word("INDEX"):
                kind += " index"
        quiet = self.quiet("IF", "EXISTS")
        return s.Drop(kind, self.name(), quiet)

    def do_show(self):
        words = [self.name().upper()]
        if words[0] == "CREATE":
            return s.Show(f"CREATE {self.name().upper()}", self.name())
        while self.kind == "name":
            words.append(self.name().upper())
        return s.Show(" ".join(words))

    def do_describe(self):
        kind = self.name().lower()
        if kind in ("tag", "edge") and self.word("INDEX"):
            kind += " index"
        return s.Describe(kind, self.name())

    do_desc = do_describe

    def rest_is_unsupported(self, what: str):
        while self.kind != "end" and not self.is_op(";"):
            self.at += 1
        return s.Unsupported(what)

    def do_grant(self):
        return self.rest_is_unsupported("GRANT")

    def do_revoke(self):
        return self.rest_is_unsupported("REVOKE")

    # --- expressions: OR, AND, one comparison, sums, products, signs ---

    def expression(self):
        e = self.conjunction()
        while self.word("OR"):
            e = s.Bin("OR", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.comparison()
        while self.word("AND"):
            e = s.Bin("AND", e, self.comparison())
        return e

    def comparison(self):
        left = self.sum()
        if op := self.op(*COMPARISONS):
            return s.Bin({"=": "==", "<>": "!="}.get(op, op), left, self.sum())
        for words in (("NOT", "CONTAINS"), ("NOT", "IN"), ("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS",), ("IN",)):
            if self.word(*words):
                return s.Bin(" ".join(words), left, self.sum())
        if self.word("IS", "NOT", "NULL"):
            return s.Call("is_not_null", (left,))
        if self.word("IS", "NULL"):
            return s.Call("is_null", (left,))
        return left

    def sum(self):
        e = self.product()
        while op := self.op("+", "-"):
            e = s.Bin(op, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while op := self.op("*", "/", "%"):
            e = s.Bin(op, e, self.unary())
        return e

    def unary(self):
        if self.op("-"):
            e = self.unary()
            return s.Lit(-e.value) if isinstance(e, s.Lit) and isinstance(e.value, int | float) else s.Un("-", e)
        if self.word("NOT") or self.op("!"):
            return s.Un("NOT", self.unary())
        return self.primary()

    def primary(self):
        kind, text = self.kind, self.text
        if kind in ("int", "float", "string"):
            self.at += 1
            value = int(text) if kind == "int" else float(text) if kind == "float" else text
            if kind == "int" and value > 2**63 - 1:
                raise QueryError("the integer is out of range")
            return s.Lit(value)
        if self.op("("):
            e = self.expression()
            self.need_op(")")
            return e
        if self.op("["):
            items = []
            while not self.op("]"):
                if items:
                    self.need_op(",")
                items.append(self.expression())
            return s.ListOf(tuple(items))
        if self.op("$$"):
            self.need_op(".")
            tag = self.name()
            self.need_op(".")
            return s.DstProp(tag, self.name())
        if self.op("$"):
            var = self.name()
            self.need_op(".")
            return s.VarCol(var, self.name())
        for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.is_word(word) and self.tokens[self.at + 1][1] not in (".", "("):
                self.at += 1
                return s.Lit(value)
        name = self.name()
        if self.op("("):
            if self.op("*"):
                self.need_op(")")
                return s.Call(name, (), True)
            args = []
            while not self.op(")"):
                if args:
                    self.need_op(",")
                args.append(self.expression())
            return s.Call(name, tuple(args))
        if self.op("."):
            second = self.name()
            return s.TagProp(name, second, self.name()) if self.op(".") else s.Prop(name, second)
        return s.Name(name)


def parse(text: str) -> s.Script:
    return Parser(text).script()
