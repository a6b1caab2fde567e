"""Filters, order and traversal on small fixtures, and random conjunctions against a plain model."""

import random

import pytest

from corvane import Comparison, InverseMatch, Match, Options, Plan, Reader, RelationshipSpec, greater_than, in_range, less_than
from corvane.errors import Break, EntryNotFound, RelationshipNotFound

SCHEMA = "id string, createdAt bigint, updatedAt bigint, userID string, contactID string, groupID string, tags array<string>, value string"
SPEC = RelationshipSpec({"users": "userID", "contacts": "contactID", "groups": "groupID", "tags": "tags"})


def rows(spark, *items):
    return spark.createDataFrame([(f"{i:08d}", 1, 1, u, c, g, t, v) for i, (u, c, g, t, v) in enumerate(items)], SCHEMA).cache()


@pytest.fixture(scope="module")
def a(spark):
    return Reader(rows(spark, ("user_0", "contact_0", "group_3", [], "1"), ("user_1", "contact_2", "group_2", [], "2"), ("user_2", "contact_2", "group_1", [], "3")), SPEC)


@pytest.fixture(scope="module")
def b(spark):
    return Reader(rows(spark, ("user_1", "contact_1", "group_1", [], "x"), ("user_2", "contact_1", "group_1", [], "y"), ("user_3", "contact_2", "group_1", [], "z"), ("user_4", "contact_2", "group_1", [], "w")), SPEC)


@pytest.fixture(scope="module")
def f(spark):
    return Reader(rows(spark, ("u", "c", "g", ["a", "b"], ""), ("u", "c", "g", ["a"], ""), ("u", "c", "g", None, ""), ("u", "c", "g", ["b", "c", "", "b"], "")), SPEC)


def ids(reader, *filters, **options):
    return [int(r.id) for r in reader.get_filtered_ids(Options(list(filters), **options)).df.collect()]


def ne(x):
    return lambda c: c != x


def test_order_of_primaries(a):
    assert ids(a, Match("contacts", "contact_2")) == [1, 2]
    assert ids(a, Match("contacts", "contact_2"), reverse=True) == [2, 1]
    assert ids(a, Comparison("users", ne("user_2"))) == [0, 1]
    assert ids(a, Comparison("groups", ne("group_2"))) == [2, 0]
    assert ids(a, Comparison("groups", ne("group_2")), reverse=True) == [0, 2]
    assert ids(a, InverseMatch("groups", "group_2")) == [2, 0]
    assert ids(a, Comparison("", ne("00000001"))) == [0, 2]
    assert ids(a) == [0, 1, 2]


def test_conjunctions(b):
    assert ids(b, Match("contacts", "contact_1"), Match("users", "user_1")) == [0]
    assert ids(b, Match("contacts", "contact_2"), Match("users", "user_2")) == []
    both = Options([Match("groups", "group_1"), Comparison("contacts", ne("contact_1"))])
    assert b.get_first(both).id == "00000002"
    assert b.get_last(both).id == "00000003"
    with pytest.raises(EntryNotFound):
        b.get_first(Options([Match("contacts", "contact_2"), Match("users", "user_2")]))


def test_inverse_depends_on_its_place(f):
    got = f.plan([InverseMatch("tags", "a")]).rows().collect()
    assert sorted((r.rel_id, int(r.id)) for r in got) == [("b", 0), ("b", 3), ("c", 3)]
    assert ids(f, Match("users", "u"), InverseMatch("tags", "a")) == [2, 3]


def test_pages(b):
    seen, token = [], ""
    for _ in range(5):
        page = b.get_filtered(Options([Match("groups", "group_1")], last_id=token, limit=1))
        seen += [int(r.id) for r in page.df.collect()]
        token = page.last_id
        if not token:
            break
    assert seen == [0, 1, 2, 3]
    assert ids(b, limit=0) == []
    assert ids(b, last_id="00000001") == ids(b, last_id="::00000001") == [2, 3]
    assert ids(b, last_id="::00000009", reverse=True) == [3, 2, 1, 0]


def test_cursor(a):
    c = a.cursor([Comparison("groups", ne("group_2"))], page=1)
    assert [c.first().id, c.next().id, c.next()] == ["00000002", "00000000", None]
    assert c.prev().id == "00000002"
    assert c.last().id == "00000000"
    one = a.id_cursor()
    assert one.seek("00000001").id == "00000001"
    assert one.seek_reverse("00000009").id == "00000002"
    assert a.cursor([InverseMatch("contacts", "contact_1")]).has("00000000")
    assert not a.cursor([InverseMatch("contacts", "contact_0")]).has("00000000")


def test_callbacks(a):
    seen = []

    def stop_at_two(entry_id):
        seen.append(entry_id)
        if len(seen) == 2:
            raise Break

    a.for_each_id(stop_at_two)
    assert seen == ["00000000", "00000001"]


def test_errors(a):
    with pytest.raises(RelationshipNotFound):
        a.plan([Match("nope", "x")])
    with pytest.raises(TypeError, match="int"):
        a.plan([3])
    with pytest.raises(EntryNotFound):
        a.get("9")
    assert a.exists("00000000") and not a.exists("9")


def test_take_while(a):
    stop = Comparison("groups", stop_when=lambda c: c == "group_2")
    assert ids(a, stop) == [2]


def test_random_conjunctions(spark):
    rnd = random.Random(7)
    pool = ["a", "b", "c", "d"]
    data = [(rnd.choice(pool), rnd.choice(pool + [""]), "g", rnd.sample(pool, rnd.randrange(4)), "") for _ in range(40)]
    reader = Reader(rows(spark, *data), SPEC)
    index = SPEC.index(reader.entries).cache()
    bags = {k: [[x for x in ([v] if isinstance(v, str) else v) if x] for v in col] for k, col in zip(("users", "contacts", "groups", "tags"), zip(*data))}
    tests = {
        Match: lambda f, xs: f.rel_id in xs,
        InverseMatch: lambda f, xs: f.rel_id not in xs,
    }
    for _ in range(12):
        filters = []
        for _ in range(rnd.randrange(1, 4)):
            key, x = rnd.choice(["users", "contacts", "tags"]), rnd.choice(pool)
            filters.append(rnd.choice([Match(key, x), InverseMatch(key, x), less_than(key, x), greater_than(key, x), in_range(key, "b", x)]))

        def holds(f, x):
            if isinstance(f, Comparison):
                low, high = f.start or "", f.end or "~"
                strict = f.predicate is not None
                return low <= x <= high and not (strict and x in (f.start, f.end))
            return (x == f.rel_id) == isinstance(f, Match)

        want = []
        for i in range(len(data)):
            if all(tests.get(type(f), lambda f, xs: any(holds(f, x) for x in xs))(f, bags[f.key][i]) for f in filters[1:]):
                head = filters[0]
                xs = [x for x in bags[head.key][i] if holds(head, x)]
                want += [("" if isinstance(head, Match) else x, i) for x in xs]
        for ix in (None, index):
            got = Plan(reader.entries, SPEC, filters, ix).rows().collect()
            assert sorted((r.rel_id, int(r.id)) for r in got) == sorted(want), (filters, ix is None)
