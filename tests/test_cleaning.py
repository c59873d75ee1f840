import json
import math
import warnings

import pytest
from pyspark.sql import functions as F

from effectlens.functions.columns import blank_to_null, nominal, ordinal_code, recode_missing, slug, to_number
from effectlens.operators import encoding as E
from effectlens.operators.selection import FeatureConflictError, FeatureSelector, NoFeaturesError, matches
from effectlens.plans import config as C
from effectlens.sources import files


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(f(F.col("c"))).collect()]


def test_blank_cells_are_null_in_unicode_too(spark):
    assert apply(spark, ["", "  ", " ", "\t\n", "x ", None], blank_to_null) == [None] * 4 + ["x ", None]


def test_numbers(spark):
    assert apply(spark, ["1.5", " 2 ", "1.5d", "1f", "x", None, "NaN", "-.5e1"], to_number) == [1.5, 2.0, None, None, None, None, None, -5.0]


def test_nominal_levels_read_alike(spark):
    assert apply(spark, [1.0, 1.5, None], lambda c: nominal(c, "double"), "double") == ["1", "1.5", "__NA__"]


def test_ordinal_with_curly_quotes(spark):
    assert apply(spark, ["don’t", "don't", "“x”", "other", None], lambda c: ordinal_code(c, ["don't", '"x"'])) == [0, 0, 1, None, None]
    assert apply(spark, ["0", "4.0", "9"], lambda c: ordinal_code(c, [0, 1, 2, 3, 4], numeric=True)) == [0, 4, None]


def test_labels_and_slugs(spark):
    assert apply(spark, [None, "nan", "NaN", "a"], recode_missing) == ["__NA__"] * 3 + ["a"]
    assert apply(spark, ["a b x c_1%"], slug) == ["abxc_1"]


def test_matching_modes():
    assert matches("abc", "abc", "exact") and matches("abc", "ab", "prefix") and matches("abc", "bc", "suffix") and matches("abc", "b", "whatever")
    assert not matches("abc", "b", "prefix")


def test_conflicting_roles_are_all_named():
    rules = {"continuous": [{"pattern": "a", "mode": "prefix"}], "nominal": [{"pattern": ["ab", "ac"], "mode": "exact"}]}
    with pytest.raises(FeatureConflictError, match="ab.*ac"):
        FeatureSelector(rules).fit(["ab", "ac", "ad"])
    with pytest.raises(NoFeaturesError):
        FeatureSelector({"nominal": [{"pattern": "zz"}]}).fit(["a"])


def test_levels_come_from_the_first_match():
    rules = {"ordinal": [{"pattern": "q", "mode": "prefix", "levels": [1, 2]}, {"pattern": "q1", "levels": [3]}]}
    found = FeatureSelector(rules).fit(["q1", "q2", "y"], outcomes=["y"])
    assert found.levels == {"q1": [1, 2], "q2": [1, 2]} and found.lists() == ([], ["q1", "q2"], [])


def test_half_unknown_levels_pass_and_more_fail(spark):
    levels = ["a", "b"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        E.check_levels(column(spark, ["a", "b", "x", "y"]), "c", levels)
    assert sum("none of its levels" in str(w.message) for w in seen) == 2
    with pytest.raises(E.LevelError):
        E.check_levels(column(spark, ["a", "x", "y"]), "c", levels)


def test_all_missing_and_missingness(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a int, b string")
    assert E.all_missing(df, ["a", "b"]) == ["b"]
    got = {r.feature: (round(r.missing_rate, 4), r.missing_count, r.total_count) for r in E.missingness(df, ["a", "b"]).collect()}
    assert got == {"a": (0.3333, 1, 3), "b": (1.0, 3, 3)}


def test_extra_columns_go_and_missing_ones_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert E.require_columns(df, ["b"]).columns == ["b"]
    with pytest.raises(KeyError, match="z"):
        E.require_columns(df, ["a", "z"])


def test_constant_column_has_scale_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert [tuple(r) for r in E.zscore(df, ["a"]).collect()] == [("a", 2.0, 1.0)]
    assert [r.a for r in E.scaled(df, ["a"]).collect()] == [0.0, 0.0]


def test_csv_separators_and_missing_values(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b;c\n1;2.5;x\n2;NA;NULL\n", encoding="utf-8")
    df = files.read_table(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2.5, "x"), (2, None, None)]


def test_config_expands_paths(tmp_path):
    (tmp_path / "c.yaml").write_text("paths: {root: /data}\nx: ['${paths.root}/a', '${paths.none}']\n", encoding="utf-8")
    with pytest.warns(UserWarning, match="paths.none"):
        assert files.load_config(str(tmp_path / "c.yaml"))["x"][0] == "/data/a"


def test_json_artifact(spark, tmp_path):
    for value in (2, 1):
        files.save_json(spark, {"b": value}, str(tmp_path / "d/x.json"))
    assert json.loads((tmp_path / "d/x.json").read_text()) == files.load_json(spark, str(tmp_path / "d/x.json")) == {"b": 1}
    assert [f.name for f in (tmp_path / "d").iterdir() if not f.name.startswith(".")] == ["x.json"]


def test_given_values_stay():
    given = {"modeling": {"outcome": "y", "cv_folds": 4, "tuning": {"search_space": {"depth": {"low": 1, "high": 2}}}}}
    c, filled = C.resolve(given, 1000)
    assert c["modeling"]["cv_folds"] == 4 and list(c["modeling"]["tuning"]["search_space"]) == ["depth"]
    assert "modeling.cv_folds" not in filled and "modeling.tuning.inner_cv_folds" in filled


def test_bad_configurations():
    with pytest.raises(ValueError, match="task_type"):
        C.resolve({"modeling": {"outcome": "y", "task_type": "x"}}, 10)
    with pytest.raises(ValueError, match="depth"):
        C.resolve({"modeling": {"outcome": "y", "tuning": {"search_space": {"depth": {"low": 2, "high": 2}}}}}, 10)


def test_trials_stay_within_bounds():
    space = C.search_space(500)
    for t in C.draw_trials(space, 50, 42):
        assert all(space[k]["low"] <= v <= space[k]["high"] for k, v in t.items())
        assert isinstance(t["depth"], int) and isinstance(t["learning_rate"], float)


def test_trials_spread_over_every_parameter():
    space = C.search_space(500)
    trials = C.draw_trials(space, 60, 42)
    for k, spec in space.items():
        place = [math.log(t[k] / spec["low"], spec["high"] / spec["low"]) if spec.get("log") else (t[k] - spec["low"]) / (spec["high"] - spec["low"]) for t in trials]
        assert min(place) < 0.1 and max(place) > 0.9, k


def test_search_learns_from_its_trials():
    """Over many goals the search comes nearer than the same number of trials over the whole space."""
    space = C.search_space(500)
    loss = {"search": 0.0, "plain": 0.0}
    for seed in range(20):
        goal = C.draw_trials(space, 1, 1000 + 37 * seed)[0]

        def judge(trials, goal=goal):
            return [-sum((math.log(t[k] / goal[k]) if s.get("log") else (t[k] - goal[k]) / (s["high"] - s["low"])) ** 2 for k, s in space.items()) for t in trials]

        ((top, place),) = C.search(space, 60, {4: seed}, lambda asked: {4: judge(asked[4])}).values()
        assert 0 <= place < 60
        loss["search"] -= judge([top])[0]
        loss["plain"] -= max(judge(C.draw_trials(space, 60, seed)))
    assert loss["search"] < 0.5 * loss["plain"]


def test_searches_go_on_side_by_side():
    space, asked = C.search_space(500), []

    def judge(trials):
        asked.append({k: len(t) for k, t in trials.items()})
        return {k: [-abs(x["depth"] - 3 - k) for x in t] for k, t in trials.items()}

    both = C.search(space, 50, {0: 1, 1: 2}, judge)
    assert [b[0]["depth"] for b in both.values()] == [3, 4] and all(a[0] == a[1] for a in asked) and sum(a[0] for a in asked) == 50
    assert both[1] == C.search(space, 50, {1: 2}, judge)[1]


def test_search_of_odd_scores_and_few_trials():
    space = {"depth": {"low": 1, "high": 12}, "kind": ["a", "b", "c"]}
    asked = []

    def judge(trials):
        asked.append(len(trials[0]))
        return {0: [None if t["kind"] == "a" else float("nan") if t["kind"] == "b" else 0.5 for t in trials[0]]}

    assert C.search(space, 42, {0: 3}, judge)[0][0]["kind"] == "c" and sum(asked) == 42 and asked[0] == 10
    assert C.search(space, 1, {0: 3}, lambda trials: {0: [0.0]}) == {0: (C.draw_trials(space, 1, 3)[0], 0)}
    assert C.search({}, 12, {0: 3}, lambda trials: {0: [float(k) for k in range(len(trials[0]))]})[0][0] == {}
    with pytest.raises(ValueError, match="n_iter"):
        C.search(space, 0, {0: 3}, judge)


EXAMPLE = """
features:
  continuous_groups:
    - {pattern: age_index, match_mode: exact, exclude: []}
    - {pattern: score_pre, match_mode: substring}
  ordinal_groups:
    - {pattern: item_pre, exclude: [total], levels: [0, 1, 2]}
    - {pattern: item, match_mode: prefix, exclude: [total], levels: [9]}
  nominal_groups:
    - {pattern: group, exclude: [code]}
"""


def test_groups_and_match_modes_of_a_configuration():
    import yaml

    columns = ["id", "age_index", "age_index_2", "my_score_pre_1", "item_pre_1", "item_pre_total", "item_x", "group_a", "group_code", "y"]
    found = FeatureSelector(yaml.safe_load(EXAMPLE)["features"]).fit(columns, ["y"], ["id"])
    assert found.roles == {"age_index": "continuous", "my_score_pre_1": "continuous", "item_pre_1": "ordinal", "item_x": "ordinal", "group_a": "nominal"}
    assert found.levels == {"item_pre_1": [0, 1, 2], "item_x": [9]}


def test_names_with_dots(spark):
    df = spark.createDataFrame([("  ", 1), ("x", 2)], "`a.b` string, `c d` int")
    assert [r[0] for r in E.clean_strings(df).orderBy("`c d`").collect()] == [None, "x"]
