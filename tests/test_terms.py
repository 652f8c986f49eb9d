import pytest

from tessera import terms as t


@pytest.mark.parametrize("text", ["ada", '"Ada"', "5", "-7", "f()", 'date(2020, "x", g(a))', "X", '"a\\"b\\\\c\\nd\\u00e9"'])
def test_parse_render_round_trip(text):
    assert t.parse(t.render(t.parse(text))) == t.parse(text)


@pytest.mark.parametrize("text", ["", "1.5", "007", "1e5", '"open', '"\\q"', '"\\ud800"', "f(", "f(a,)", "a b", '"\\U00110000"'])
def test_rejects(text):
    with pytest.raises(t.TermError):
        t.parse(text)


def test_big_numbers_stay_exact():
    n = "9" * 60
    assert t.from_json(t.to_json(t.parse(n))) == t.Num(int(n))


def test_leaf_twins_are_equal_and_compounds_are_structural():
    assert t.key(t.parse("ada")) == t.key(t.parse('"ada"'))
    assert t.key(t.parse("5")) == t.key(t.parse('"5"'))
    assert t.key(t.parse("f(x)")) != t.key(t.parse('f("x")'))


def test_storage_is_strict_and_nfc():
    assert t.to_json(t.Str("é")) == '{"t":"string","v":"\\u00e9"}'
    for bad in ['{"v":"a","t":"string"}', '{"t":"string"}', '{"t":"atom","v":"A b"}', "[]", '{"t":"number","v":true}']:
        with pytest.raises(t.TermError):
            t.from_json(bad)


def test_display_forms():
    s = t.Str("a, b\n ‮")
    assert t.shown(s) == "a, b\\n\\u2028\\u202E"
    assert t.answer(s) == "a\\, b\\n\\u2028\\u202E"
    assert t.surface(s) == "a, b\n ‮"
