"""Who is who: all five rules against a plain reckoning over all pairs."""

import random

import pandas as pd

from effortlens.operators import identity
from effortlens.plans import measures, registry
from tests.compare import SF

SCHEMA = "id long, name string, login string, email string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def is_initial(word):
    return len(word) <= 2 and len(word.replace(".", "")) == 1


def match(p, q):
    if p[3].lower() == q[3].lower():
        return None
    a, b = (" ".join(x[1].lower().split()) for x in (p, q))
    if a == b:
        return "HIGH", "name"
    if p[2] and p[2] == q[2]:
        return "HIGH", "login"
    (f, l), (g, m) = ((x.split(" ")[0], x.split(" ")[-1]) for x in (a, b))
    if l and l == m and f != g and ((is_initial(f) and g.startswith(f[0])) or (is_initial(g) and f.startswith(g[0]))):
        return "MEDIUM", "initial"
    d, e = (x[3].lower().partition("@")[2] for x in (p, q))
    n = edits(a, b)
    if d and d == e and d not in identity.PUBLIC_DOMAINS and n <= 3:
        return "MEDIUM", "domain"
    return ("LOW", "spelling") if n <= 2 else None


def everyone(n=260):
    r = random.Random(5)
    firsts = "ann anne a. b ben Bend cora dora j j. john jon maximiliana-josephine".split()
    lasts = "smith smyth smithe jones johnes li lee vandenbroucke vandenbrouke featherstonehaugh featherstonhaw".split()
    out = []
    for i in range(n):
        name = f"{r.choice(firsts)}{r.choice((' ', '  '))}{r.choice(lasts)}"
        if r.random() < 0.4:
            k = r.randrange(len(name))
            name = name[:k] + r.choice(("", "z", "q" + name[k])) + name[k + 1 :]
        mail = f"{r.choice('pqPQ')}{r.randrange(90)}@{r.choice(('firm.example', 'Gmail.com', 'other.example', 'mail.ru'))}"
        out.append((i, name, r.choice((None, "", f"u{r.randrange(60)}")), mail))
    return [*out, (n, "", None, "x@firm.example"), (n + 1, " ", "u1", "nothing")]


def test_five_rules_against_all_pairs(spark):
    people = everyone()
    wanted = {(p[0], q[0]): m for i, p in enumerate(people) for q in people[i + 1 :] if (m := match(p, q))}
    assert {m[1] for m in wanted.values()} == {"name", "login", "initial", "domain", "spelling"}
    frame = spark.createDataFrame(people, SCHEMA)
    assert {(r["a"], r["b"]): (r["confidence"], r["reason"]) for r in identity.find_matches(frame).collect()} == wanted


def test_links_have_the_components_of_all_pairs(spark):
    people = everyone(90)
    groups = {p[0]: p[0] for p in people}
    pairs = [(p[0], q[0]) for i, p in enumerate(people) for q in people[i + 1 :] if match(p, q)]
    for _ in people:
        for a, b in pairs:
            groups[a] = groups[b] = min(groups[a], groups[b])
    linked = {x for pair in pairs for x in pair}
    found = {r["id"]: r["group"] for r in identity.match_groups(identity.match_links(spark.createDataFrame(people, SCHEMA))).collect()}
    assert found == {x: groups[x] for x in linked}


def test_near_names_keys_lose_nothing():
    r = random.Random(7)
    for _ in range(3000):
        n = r.randrange(0, 34)
        a = "".join(r.choice("abc ") for _ in range(n))
        b = a
        for _ in range(r.randrange(4)):
            k = r.randrange(len(b) + 1)
            b = b[:k] + r.choice(("", "a", "x")) + b[k + r.randrange(2) :]
        k = edits(a, b)
        for limit in range(max(k, 2), 4):
            assert identity.name_keys(a, limit)[0] & identity.name_keys(b, limit)[1]
            assert identity.name_keys(b, limit)[0] & identity.name_keys(a, limit)[1]


def test_queries_leave_no_customer_out(spark):
    people = [tuple(r) for r in measures._everyone(spark, SF).collect()]
    assert {p[0] for p in people} == set(pd.read_parquet(f"{SF}/customer.parquet").c_custkey)
    wanted = {(p[0], q[0]): m for p in people for q in people if p[0] < q[0] and (m := match(p, q))}
    assert {(r["a"], r["b"]): (r["confidence"], r["reason"]) for r in registry.QUERIES["dup_pairs"](spark, SF).collect()} == wanted
    found = {r["id"]: r["group_id"] for r in registry.QUERIES["dup_groups"](spark, SF).collect()}
    assert set(found) == {x for pair in wanted for x in pair}
    assert all(found[a] == found[b] for a, b in wanted)


def test_match_chain_finds_every_supplier_that_is_asked_for(spark):
    suppliers = set(pd.read_parquet(f"{SF}/supplier.parquet").s_suppkey)
    rows = {r["c_custkey"]: (r["found"], r["found_by"]) for r in registry.QUERIES["match_chain"](spark, SF).collect()}
    for key in pd.read_parquet(f"{SF}/customer.parquet").c_custkey:
        by_id, by_login = key % 4 != 0 and key * 3 in suppliers, key % 6 != 0 and key // 5 in suppliers
        assert rows[key] == ((key * 3, "provider") if by_id else (key // 5, "login") if by_login else (None, None))
