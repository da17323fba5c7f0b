import random

import pytest

from skein.operators import episodes as E

SCHEMA = "session_key string, entry_id string, line_no int, ordinal int, tool_name string, command_family string, error_signature string, is_error int, timestamp string, project_key string, source_name string, machine_id string"


def _rows(spark, steps):
    """steps: (session, family, failed, timestamp)."""
    return spark.createDataFrame([(s, f"e{i:04d}", i, 0, "Bash", f, "boom" if bad else "", int(bad), t, f"p{s}", "pi", "m") for i, (s, f, bad, t) in enumerate(steps)], SCHEMA)


def _machine(steps, gap, most):
    """A plain state machine over one session after another."""
    out = []
    for session in dict.fromkeys(s[0] for s in steps):
        rows = sorted(((-1 if t == "" else int(t[14:16]) * 60 + int(t[17:19]) + int(t[11:13]) * 3600, i, f, bad, t) for i, (s, f, bad, t) in enumerate(steps) if s == session), key=lambda r: (r[0], r[1]))
        held = {}
        for n, (when, i, f, bad, _) in enumerate(rows):
            if bad:
                if f not in held:
                    held[f] = (n, when, len(out))
                    out.append([session, f"e{i:04d}", 0, None])
            elif f in held:
                o, then, k = held.pop(f)
                if n - o + 1 <= most and (when < 0 or then < 0 or when - then <= gap):
                    out[k][2], out[k][3] = 1, [r[2] for r in rows[o + 1:n + 1]]
    return sorted(map(tuple, ((a, b, c, tuple(d) if d else None) for a, b, c, d in out)))


@pytest.mark.parametrize("seed", range(3))
def test_windows_match_a_state_machine(spark, seed):
    rng = random.Random(seed)
    steps = [(f"s{rng.randrange(25)}", f"f{rng.randrange(4)}", rng.random() < 0.5, "" if rng.random() < 0.15 else f"2026-01-01T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00Z") for _ in range(900)]
    got = E.assemble(_rows(spark, steps), 3 * 3600, 6).collect()
    assert sorted((r.session_key, r.open_entry_id, r.resolved, tuple(r.resolution_path) if r.resolution_path else None) for r in got) == _machine(steps, 3 * 3600, 6)


def test_worked_incident_and_trajectory(spark):
    at = lambda n: f"2026-01-01T00:{n:02d}:00Z"
    fam = "confluent topic describe"
    steps = [("s1", fam, 1, at(0)), ("s1", fam, 1, at(1))]
    for s in ("s2", "s4", "s6"):
        steps += [(s, fam, 1, at(0)), (s, "a", 0, at(1)), (s, "b", 0, at(2)), (s, fam, 0, at(3))]
    steps += [("s3", fam, 1, at(0)), ("s3", "a", 0, at(1)), ("s3", "b", 0, at(2)), ("s3", "c", 0, at(3)), ("s3", fam, 0, at(4)), ("s5", fam, 1, at(0)), ("s5", "other", 0, at(1))]
    inv = _rows(spark, steps)
    eps = E.assemble(inv).persist()
    top = E.incidents(eps).first()
    assert (top.episodes, top.resolved, top.state, top.tier) == (6, 4, "partial", "established")
    best = E.resolution_paths(eps).orderBy("rank").first()
    assert (best.resolution_path, best.support, best.trials) == (["a", "b", fam], 3, 4)
    done = eps.where("session_key = 's3' and resolved = 1").first()
    walk = E.trajectory(inv, eps, "s3", done.resolve_entry_id).collect()
    assert [r.command_family for r in walk] == [fam, "a", "b", "c", fam]
    assert E.trajectory(inv, eps, "s3", "nothing").collect() == []
    assert E.sparklines(eps, E.incidents(eps)).agg({"n": "sum"}).first()[0] == 6
    with pytest.raises(ValueError):
        E.incidents(eps, "odd")


def test_later_success_flips_an_abandoned_episode(spark):
    steps = [("s", "f", 1, "2026-01-01T00:00:00Z")]
    assert E.assemble(_rows(spark, steps)).first().resolved == 0
    assert E.assemble(_rows(spark, [*steps, ("s", "f", 0, "2026-01-01T00:01:00Z")])).first().resolved == 1
    assert E.assemble(_rows(spark, [])).count() == 0


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "TASK_ROWS", 50, raising=False)
    steps = [(f"s{i % 60}", f"f{i % 3}", i % 7 < 3, f"2026-01-01T{i % 24:02d}:00:00Z") for i in range(1000)]
    held = E.ordered(_rows(spark, steps)).groupBy(F.spark_partition_id()).count().collect()
    # 20 tasks, some of which may get no session
    assert len(held) > 10 and sum(r["count"] for r in held) == 1000
    got = E.assemble(_rows(spark, steps), 3 * 3600, 6).collect()
    assert sorted((r.session_key, r.open_entry_id, r.resolved, tuple(r.resolution_path) if r.resolution_path else None) for r in got) == _machine(steps, 3 * 3600, 6)
