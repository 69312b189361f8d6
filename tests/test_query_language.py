import pytest

from scriptorium.plans import query as Q
from scriptorium.plans import rewrites as R


def plan(s, **p):
    n = Q.parse(s)
    for name, f in R.PASSES:
        if name in ("root", "cast", "flatten"):
            break
        n = f(n, p)
    return str(n)


@pytest.mark.parametrize("s", ["#combine:0=0.8:1=0.2( #text:oak() #text:elm() )", "#ordered:1( #text:a() #text:b() )", "#text:@/x y/()", "#combine:norm=false( #text:a() )"])
def test_printing_round_trip(s):
    assert str(Q.parse(s)) == s


def test_words_quotes_fields():
    assert str(Q.parse("a")) == "#text:a()"
    assert str(Q.parse("a b")) == "#root( #text:a() #text:b() )"
    assert str(Q.parse('"a b" c')) == "#root( #quote( #text:a() #text:b() ) #text:c() )"
    assert str(Q.parse("a.title")) == "#inside( #text:a() #extents:title:part=extents() )"
    assert str(Q.parse("#text:@/3/()")) == "#text:@/3/()"
    assert Q.parse("#x:1:b=2.5:c=true( y )").p == {"default": 1, "b": 2.5, "c": True}
    assert str(Q.parse(None)) == "#root()"


@pytest.mark.parametrize("s", ["#combine( a", "a )", "#( a )", "#x:1:1( a )", "a.(b)", "#combine a"])
def test_bad_queries(s):
    with pytest.raises(Q.QueryError):
        Q.parse(s)


def _dependence(words, weights, reach=2):
    """The tree by the rule: terms, then runs of up to ``reach`` adjacent terms in order at width
    one, then the same runs in any order within four places a term."""
    t = [f"#text:{w}()" for w in words]
    runs = [t[i : i + n] for n in range(2, reach + 1) for i in range(len(t) - n + 1)]
    join = lambda op, parts: f"#{op}( {' '.join(parts)} )"
    parts = [join("combine", t), join("combine", [join("ordered:1", r) for r in runs]), join("combine", [join(f"unordered:{4 * len(r)}", r) for r in runs])]
    return join("combine:" + ":".join(f"{i}={w}" for i, w in enumerate(weights)), parts)


@pytest.mark.parametrize("words", [["quiet", "harbour"], ["north", "wind", "over", "fields"], ["a", "b", "a", "c", "d"]])
def test_dependence_of_adjacent_terms(words):
    q = " ".join(words)
    assert plan(f"#sdm( {q} )") == _dependence(words, (0.8, 0.15, 0.05))
    assert plan(f"#sdm( {q} )", odw=0.3) == _dependence(words, (0.8, 0.3, 0.05))
    assert plan(f"#sdm:uww=0.4( {q} )", uniw=0.6, uww=0.9) == _dependence(words, (0.6, 0.15, 0.4))
    assert plan(f"#sdm( {q} )", windowLimit=len(words)) == _dependence(words, (0.8, 0.15, 0.05), len(words))


def test_dependence_of_one_term():
    assert plan("#sdm( mill )") == "#combine( #text:mill() )"


def test_full_dependence_sets():
    s = plan("#fdm( a b c )")
    assert s.count("#ordered:1(") == 4 and "#unordered:12( #text:a() #text:b() #text:c() )" in s and "#unordered:8( #text:a() #text:c() )" in s


def test_flatten_and_merge():
    n = R.rewrite(Q.parse("#combine:0=2:1=1( #combine( a b ) a )"))
    assert str(n) == "#combine:0=2.0:1=1.0( #dirichlet( #text:a() ) #dirichlet( #text:b() ) )"
    assert str(R.rewrite(Q.parse("#combine( #ordered:1( a ) )"))) == "#dirichlet( #text:a() )"


def test_stopping_and_replacement():
    assert str(R.rewrite(Q.parse("#stopword( the oak )"))) == "#dirichlet( #text:oak() )"
    q = {"stopstructures": ["tell me", "tell me about"]}
    assert str(R.rewrite(Q.parse("#stopstructure( tell me about cats )"), q)) == "#dirichlet( #text:cats() )"
    assert str(R.rewrite(Q.parse("#foo( a b )"), {"opRepls": {"foo": ["combine", "ordered"]}})) == "#dirichlet( #ordered( #text:a() #text:b() ) )"


def test_simple_syntax():
    assert str(Q.parse_simple('a^2 "b c" title:d')) == "#combine:0=2.0:1=1.0:2=1.0( #text:a() #ordered:1( #text:b() #text:c() ) #inside( #text:d() #extents:title:part=extents() ) )"


def test_user_pass_and_unknown_operator():
    R.register("shout", lambda n, q: Q.transform(n, lambda x: x.with_params(default="B") if x.op == "text" else x), before="root")
    try:
        assert str(R.rewrite(Q.parse("a"))) == "#dirichlet( #text:B() )"
    finally:
        R.PASSES[:] = [p for p in R.PASSES if p[0] != "shout"]
    with pytest.raises(Q.QueryError):
        R.rewrite(Q.parse("#nonsense( a )"))
