"""Options by path: inheritance, scopes and output keys, without Spark."""

import pytest

from cliploom.config import flatten, in_scope, output_names, resolve

PATHS = [("a",), ("b",), ("c",), ("d", "e"), ("d", "f"), ("g",)]


def test_inheritance():
    config = flatten({"b": {"minval": -1, "maxval": 3}, "c": {"maxval": 4}, "d": {"minval": -3, "e": {"minval": -2}, "f": {"maxval": 2}}})
    got = {p: tuple(resolve(config, p, {"minval": 0, "maxval": 1}).values()) for p in PATHS[:5]}
    assert got == {("a",): (0, 1), ("b",): (-1, 3), ("c",): (0, 4), ("d", "e"): (-2, 1), ("d", "f"): (-3, 2)}


def test_top_level_entries_hold_everywhere_and_none_is_unset():
    assert resolve(flatten({"x": 5, "d": {"x": None}}), ("d", "e"), {"x": 0}) == {"x": 5}


def test_scope_denial_inside_an_allowed_part():
    scope = flatten({"b": {"scope": True}, "d": {"scope": True, "f": {"scope": False}}, "g": {"scope": True}})
    assert [in_scope(scope, p) for p in PATHS] == [False, True, False, True, False, True]


def test_scope_denial_above_wins_over_permission_below():
    assert not in_scope(flatten({"d": {"scope": False, "e": {"scope": True}}}), ("d", "e"))
    assert in_scope(flatten({}), ("d", "e"))


def test_lists_inside_options_are_refused():
    with pytest.raises(TypeError):
        flatten({"a": {"x": [1, 2]}})


def test_output_names():
    existing = {("src",): ["GT"], ("target",): ["GT", "modified"]}
    assert output_names([("src", "GT")], existing, lambda p: f"{p[-1]}_modified") == {("src", "GT"): "GT_modified"}
    with pytest.warns(UserWarning):
        assert output_names([("src", "GT"), ("target", "GT")], existing, "modified") == {("src", "GT"): "modified", ("target", "GT"): None}
    with pytest.raises(ValueError, match="both write"):
        output_names([("d", "e"), ("d", "f")], {}, "same")
