import json
import random
from collections import Counter

from scangraph.sources.resolver import flatten_answers


def line(name, answers):
    return json.dumps({"name": name, "data": {"answers": [dict(zip(("name", "type", "data"), a)) for a in answers]}})


def flatten(spark, lines):
    rows = flatten_answers(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    return Counter((r.ip, r.domain, r.type) for r in rows)


def test_aliases_are_followed_and_cycles_end(spark):
    lines = [
        line(
            "www.a.com.",
            [
                ("www.a.com.", "CNAME", "a.cdn.net."),
                ("a.cdn.net.", "CNAME", "b.cdn.net."),
                ("b.cdn.net. ", "A", "9.9.9.9"),
                ("b.cdn.net.", "AAAA", "2001:db8::9"),
                ("b.cdn.net.", "MX", "mail"),
            ],
        ),
        line("l1.com", [("l1.com", "CNAME", "l2.com"), ("l2.com", "CNAME", "l1.com"), ("s.com", "CNAME", "s.com")]),
        "no json",
        '{"name": "x"}',
        "",
    ]
    names = ("www.a.com", "a.cdn.net", "b.cdn.net")
    expected = Counter([("9.9.9.9", n, "A") for n in names] + [("2001:db8::9", n, "AAAA") for n in names])
    assert flatten(spark, lines) == expected


def walk(answers):
    """Every path of distinct names from an alias to an address."""
    found = Counter()

    def follow(alias, at, seen):
        if at in seen:
            return
        for name, kind, data in answers:
            if name == at and kind == "CNAME":
                follow(alias, data, seen | {at})
            elif name == at:
                found[(data, alias, kind)] += 1

    for name, kind, data in answers:
        if kind == "CNAME":
            follow(name, data, {name})
        else:
            found[(data, name, kind)] += 1
    return found


def test_random_answers_match_path_enumeration(spark):
    rng = random.Random(3)
    lines, expected = [], Counter()
    for n in range(40):
        names = [f"n{n}-{i}.com" for i in range(5)]
        answers = [
            (rng.choice(names), "CNAME", rng.choice(names)) if rng.random() < 0.6 else (rng.choice(names), "A", f"10.0.{n}.{i}")
            for i in range(rng.randint(0, 8))
        ]
        lines.append(line(names[0], answers))
        expected += walk(answers)
    assert flatten(spark, lines) == expected


def test_answers_without_data_are_skipped_alone(spark):
    found = flatten(spark, [line("a.com.", [("a.com.", "A", None), ("a.com.", "A", "1.1.1.1"), ("b.com.", "CNAME", "a.com.")])])
    assert found == {("1.1.1.1", "a.com", "A"): 1, ("1.1.1.1", "b.com", "A"): 1}
