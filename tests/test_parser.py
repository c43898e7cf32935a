import pytest

from knotwork.errors import QueryError
from knotwork.plans import syntax as s
from knotwork.plans.parser import parse


def one(text):
    return parse(text).clauses[0][1]


def test_match_shape():
    q = one('MATCH (a:person {name: "x"})-[e:knows|likes]->(b)<-[:f*1..3]-(c:x|y) WHERE a.person.age >= -3 RETURN id(a) AS v ORDER BY v DESC LIMIT 3 OFFSET 1')
    assert [n.var for n in q.patterns[0].nodes] == ["a", "b", "c"]
    assert q.patterns[0].edges[0].types == ("knows", "likes") and q.patterns[0].edges[1].span == (1, 3)
    assert q.patterns[0].nodes[2].any_label and (q.limit, q.offset) == (3, 1)


def test_star_without_two_bounds_is_one_hop():
    assert one("MATCH (a)-[:e*]->(b) RETURN a").patterns[0].edges[0].span is None
    assert one("MATCH (a)-[:e*3]->(b) RETURN a").patterns[0].edges[0].span is None


def test_comments_and_keywords_as_names():
    q = one("MATCH (match:tag) /* c */ RETURN id(match) AS go // end")
    assert q.items[0].alias == "go"


def test_precedence():
    e = one("LOOKUP ON t WHERE a == 1 OR b == 2 AND NOT c == 3").where
    assert e.op == "OR" and e.right.op == "AND"


@pytest.mark.parametrize("text", ["", "FROB", "MATCH (a:x:y|z) RETURN a", "GO FROM 1", "RECOMMEND SIMILAR TO 1 OVER e LIMIT 0", "FIND SHORTEST PATH FROM 1 TO 2 OVER a,b", "CREATE TAG t(x GEOGRAPHY)", "MATCH (a {x: y}) RETURN a", "FETCH PROP ON t 1, 2->3"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_statements():
    assert one("INSERT EDGE e(a) VALUES 1->2@7:(x)").rows == ((1, 2, 7, ("x",)),)
    assert one("CREATE EDGE anc() TRANSITIVE SUBPROPERTY OF rel CHAIN a, b").options == {"transitive": True, "sub": "rel", "chain": ("a", "b")}
    assert one("CREATE SPACE s (vid_type = FIXED_STRING(32))").options["vid_length"] == 32
    assert isinstance(one("BALANCE DATA"), s.Unsupported)
    assert parse("$a = GO FROM 1 OVER *; FETCH PROP ON t $a.dst").clauses[0][0] == "a"
