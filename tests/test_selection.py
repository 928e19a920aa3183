"""Chunks of a stage against a plain version, and every point by itself."""

import random

from auditloom.operators.selection import STAGE_KEYWORDS, select_stage_chunks

LABELS = {2: "rce", 3: "injection", 7: "config", 9: "business"}
CHUNKS = "project string, chunk_ordinal int, file_path string, base_file_path string, chunk_type string, content string, risk_score int, risk_labels array<string>"


def brute(chunks, routes, evidence, hints, files, functions):
    out = []
    for project in sorted({c[0] for c in chunks}):
        own = sorted((c for c in chunks if c[0] == project), key=lambda c: c[1])
        for stage, words in STAGE_KEYWORDS.items():
            hinted = {f.lower() for p, f, s in hints if p == project and stage in s}
            known = {e.lower() for p, e in evidence if p == project} | hinted
            scored, rest = [], []
            for _, k, path, base, kind, content, risk, labels in own:
                head, low = (content or "")[:4000].lower(), path.lower()
                b = (base or path).lower()
                n = (risk or 0) + 8 * (b in {r.lower() for p, r in routes if p == project}) + 6 * (b in known) + (5 if kind.startswith("oversized_signal") else 2 if kind.startswith("oversized_") else 0)
                n += 8 * (LABELS[stage] in [x.lower() for x in labels or []]) + 3 * any(d in b for d in ("/routes/", "/routers/", "/api/", "/controller", "/controllers/", "urls.py", "views.py"))
                n += 2 * any(d in b for d in ("/auth", "/security", "/middleware", "config", "settings", ".env"))
                n += 10 * (low in hinted) + 30 * (low in {f.lower() for p, f in files if p == project}) + 8 * any(f.lower() in head for p, f in functions if p == project)
                if any(w in low + "\n" + head for w in words):
                    scored.append((-(n + 12), path, k))
                elif n > 0:
                    scored.append((-n, path, k))
                else:
                    rest.append((0, path, k))
            picked = sorted(scored)[:32]
            out += [(project, stage, k, -s, i, False) for i, (s, _, k) in enumerate(picked, 1)]
            out += [(project, stage, k, 0, len(picked) + i, True) for i, (_, _, k) in enumerate(rest[: max(0, 16 - len(picked))], 1)]
    return sorted(out)


def test_selection_equals_a_plain_version(spark):
    rng = random.Random(4)
    words = ["exec", "sql", "nginx", "refund", "nothing", "plain", "more", "text", "Handle(", "x" * 4100]
    rows = []
    for project, n in (("a", 90), ("b", 20), ("c", 3)):
        for k in range(n):
            base = rng.choice(["src/api/u.py", "lib/x.py", "Auth/y.py", "z.txt", "conf/settings.py", f"d/{k}.py"])
            path = base if rng.random() < 0.7 else f"{base}#part{k}"
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 3)))
            rows.append((project, k, path, base if rng.random() < 0.9 else None, rng.choice(["full", "split", "oversized_signal", "oversized_head"]) if rng.random() < 0.3 else "full", text if rng.random() < 0.95 else None, rng.choice([0, 0, 0, 3]), rng.choice([None, [], [], ["rce"], ["Business", "auth"]])))
    routes, evidence = [("a", "src/API/u.py"), ("b", "none.py")], [("a", "z.txt"), ("b", "lib/x.py")]
    hints = [("a", "lib/x.py", [3, 9]), ("b", "z.txt", [2]), ("a", "", [2])]
    files, functions = [("a", "d/7.py"), ("b", "Auth/y.py")], [("a", "handle("), ("b", " ")]
    frame = spark.createDataFrame
    given = (frame(rows, CHUNKS).repartition(3), frame(routes, "project string, file_path string"), frame(evidence, "project string, path string"), frame(hints, "project string, file_path string, stage_nums array<int>"))
    got = select_stage_chunks(*given, frame(files, "project string, path string"), frame(functions, "project string, name string"))
    want = brute(rows, routes, evidence, hints, files, [f for f in functions if f[1].strip()])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {r[5] for r in want} == {True, False} and {r[1] for r in want} == set(STAGE_KEYWORDS)
    none = select_stage_chunks(given[0], *(g.limit(0) for g in given[1:]))
    assert sorted(tuple(r) for r in none.collect()) == brute(rows, [], [], [], [], [])
