import json

import pytest

from taxaloom.operators import schema, validation

SPEC = {
    "default_range": "string",
    "classes": {
        "Page": {"mixin": True, "slots": ["state", "tags"]},
        "Work": {"is_a": "Thing", "mixins": ["Page"], "slots": ["year", "trials"], "slot_usage": {"name": {"required": True}}},
        "Thing": {"slots": ["name"], "attributes": {"score": {"range": "float", "minimum_value": 0, "maximum_value": 1}}},
        "Trial": {"mixins": ["Page"], "slots": ["host", "sets", "of_work"]},
        "Set": {"slots": ["direction", "members", "day"]},
        "Member": {"slots": ["number", "label"]},
        "Paper": {"slots": ["key"]},
    },
    "slots": {
        "name": None,
        "state": {"range": "State"},
        "tags": {"multivalued": True, "pattern": "^[a-z]+$"},
        "year": {"range": "integer"},
        "trials": {"range": "Trial", "multivalued": True, "inlined_as_list": True},
        "host": {"required": True},
        "sets": {"range": "Set", "multivalued": True},
        "direction": {"range": "Direction"},
        "members": {"range": "Member", "multivalued": True},
        "day": {"range": "date"},
        "number": {"range": "integer", "required": True},
        "label": {},
        "of_work": {"range": "Paper"},
        "key": {"identifier": True},
    },
    "enums": {"State": {"permissible_values": {"Done": None, "Open": {"description": "x"}}}, "Direction": {"permissible_values": {"up": {}, "down": {}}}},
}
GOOD = {"name": "a", "state": "Open", "tags": ["x", "yz"], "year": 2020, "score": 0.5, "trials": [{"host": "h", "of_work": "k1", "sets": [{"direction": "up", "day": "2020-01-31", "members": [{"number": 1, "label": "l"}, {"number": 2}]}, {}]}, {"host": "i", "state": None}]}


def changed(path, value):
    """GOOD with another value at a path; none takes it away."""
    out = json.loads(json.dumps(GOOD))
    *way, last = [int(p) if p.isdigit() else p for p in path.strip("/").split("/")]
    at = out
    for p in way:
        at = at[p]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return out


CASES = [
    (GOOD, []),
    ({"name": "only"}, []),
    (changed("/name", None), [("/", "'name' is required", "Work")]),
    (changed("/year", "soon"), [("/year", "'soon' is not of type integer", "Work")]),
    (changed("/year", 1.5), [("/year", "'1.5' is not of type integer", "Work")]),
    (changed("/score", 1.25), [("/score", "'1.25' is more than 1", "Work")]),
    (changed("/score", -1), [("/score", "'-1' is less than 0", "Work")]),
    (changed("/state", "Lost"), [("/state", "'Lost' is not one of State", "Work")]),
    (changed("/state", 3), [("/state", "'3' is not one of State", "Work")]),
    (changed("/tags/1", "Y Z"), [("/tags/1", "'Y Z' does not match ^[a-z]+$", "Work")]),
    (changed("/tags", "x"), [("/tags", "'x' is no list", "Work")]),
    (changed("/more", 1), [("/", "properties that the class does not have: more", "Work")]),
    (changed("/trials/0/host", None), [("/trials/0", "'host' is required", "Trial")]),
    (changed("/trials/0/odd", 1), [("/trials/0", "properties that the class does not have: odd", "Trial")]),
    (changed("/trials/1", "text"), [("/trials/1", "'text' is no object", "Trial")]),
    (changed("/trials/0/of_work", {"key": "k"}), [("/trials/0/of_work", "'{\"key\":\"k\"}' is not of type string", "Trial")]),
    (changed("/trials/0/sets/0/direction", "sideways"), [("/trials/0/sets/0/direction", "'sideways' is not one of Direction", "Set")]),
    (changed("/trials/0/sets/0/day", "31 Jan"), [("/trials/0/sets/0/day", "'31 Jan' does not match ^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "Set")]),
    (changed("/trials/0/sets/0/members/1/number", "2"), [("/trials/0/sets/0/members/1/number", "'2' is not of type integer", "Member")]),
    (changed("/trials/0/sets/0/members/0", [1]), [("/trials/0/sets/0/members/0", "'[1]' is no object", "Member")]),
    (dict(GOOD, year=True, trials=[{"sets": [{"direction": "x"}]}]), [("/year", "'true' is not of type integer", "Work"), ("/trials/0", "'host' is required", "Trial"), ("/trials/0/sets/0/direction", "'x' is not one of Direction", "Set")]),
]


def test_problems_and_paths(spark):
    compiled = schema.parse(SPEC)
    assert [s.name for s in compiled.slots("Work")] == ["name", "score", "state", "tags", "year", "trials"]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)], "k int, record string")
    got = {r.k: [(p.path, p.message, p.instantiates) for p in r.problems] for r in schema.validate(rows, compiled, "Work").collect()}
    for k, (record, want) in enumerate(CASES):
        assert sorted(got[k]) == sorted(want), record


def test_other_targets_and_what_is_no_record(spark):
    compiled = schema.parse(SPEC)
    rows = spark.createDataFrame([('{"direction": "down"}',), ("[1]",), ("{",), (None,), ("3",)], "record string")
    found = schema.validate(rows, compiled, "Set")
    assert [(r.valid, [p.severity for p in r.problems]) for r in found.collect()] == [(True, [])] + [(False, ["FATAL"])] * 4
    assert validation.exit_code(found) == 2
    assert validation.exit_code(found.where("valid")) == 0
    with pytest.raises(schema.SchemaError, match="Nothing"):
        schema.validate(rows, compiled, "Nothing")


def test_files_and_faulty_schemas(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(SPEC))
    assert schema.load(str(path)) is schema.load(str(path)) and schema.load(str(path)) == schema.parse(SPEC)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(SPEC, sort_keys=False))
    assert schema.load(str(tmp_path / "s.yaml")) == schema.parse(SPEC)
    with pytest.raises(schema.SchemaError):
        schema.load(str(tmp_path / "none.yaml"))
    with pytest.raises(schema.SchemaError, match="itself"):
        schema.parse({"classes": {"A": {"is_a": "B"}, "B": {"is_a": "A"}}})
    loop = schema.parse({"classes": {"A": {"slots": ["a"]}}, "slots": {"a": {"range": "A"}}})
    from pyspark.sql import functions as F

    with pytest.raises(schema.SchemaError, match="nests"):
        schema.problems(F.lit("{}"), loop, "A")


def test_problems_are_found_once(spark):
    """The plan of nested_validation asks for the problems of a record in one place, not in a filter before as well."""
    from pathlib import Path

    import pytest

    from taxaloom.plans import registry

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    plan = registry.QUERIES["nested_validation"](spark, str(data))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "transform(" in line for line in plan.split("\n"))
