import math

from pyspark.sql import functions as F

from skein.functions import redaction as R
from skein.functions import scalars as S


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())).select(column.alias("x")).first().x


def test_wilson_and_spread(spark):
    w = _one(spark, S.wilson(F.col("a"), F.col("b")), a=8.0, b=10.0)
    assert math.isclose(w, 0.49015684672072346, rel_tol=1e-12)
    assert _one(spark, S.wilson(F.col("a"), F.col("b")), a=0.0, b=0.0) == 0
    for s, p, want in ((1, 1, 1), (3, 1, 3), (1, 3, 2), (3, 2, 3.5), (0, 0, 0)):
        assert _one(spark, S.spread(F.col("a"), F.col("b")), a=float(s), b=float(p)) == max(0, want)


def test_command_family(spark):
    rows = [("Shell", "cargo build --release -p core", "cargo build"), ("Shell", "docker compose up -d", "docker compose up"), ("Shell", "kubectl get pods web", "kubectl get pods"), ("Shell", "curl -s http://h/x", "curl"), ("Shell", "  pytest   tests/unit ", "pytest"),
            ("Edit", None, "Edit"), ("Edit", " \t", "Edit"), ("Shell", "cd /srv/app && make lint fast now", "make lint fast"), ("Shell", "K=v cd src && npm run dev", "npm run dev"), ("Shell", "DB_PASSWORD=short run it", "run it"), ("Shell", "N=1 M=2", "Shell"),
            ("Shell", "sort names | uniq", "sort names"), ("Shell", "true; rm x", "true"), ("Shell", "sleep 5 & wait", "sleep 5"), ("Shell", "echo $HOME", "echo"), ("Shell", "tar\nls", "tar")]
    df = spark.createDataFrame(rows, "tool string, command string, want string").withColumn("got", R.command_family(F.col("tool"), F.col("command")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_error_signature_is_stable_and_private(spark):
    sig = R.error_signature(F.col("t"))
    a = _one(spark, sig, t="pull https://x.io/pr/12 failed at /a/b/c: 'x' deadbeef01 99")
    assert a == _one(spark, sig, t="pull https://x.io/pr/77 failed at /d/e: 'zz' cafebabe77 1")
    assert "secrettoken" not in _one(spark, sig, t="Authorization: Bearer secrettoken123")
    assert _one(spark, sig, t="  ") == ""


SECRETS = ["sk-ant-" + "a" * 24, "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "github_pat_" + "a" * 24, "ghp_" + "a" * 24, "xoxb-" + "1" * 12, "npm_" + "a" * 24, "pypi-" + "a" * 24, "AKIA" + "A" * 16, "AIza" + "a" * 35,
           "sk_live_" + "a" * 26, "robot-1@proj.iam.gserviceaccount.com", "CF_API_TOKEN=" + "a" * 24, "eyJ" + ".".join(["a" * 12] * 3), "Authorization: Bearer abcdefgh12", "https://user:pass@host", "password = hunter2hunter2", "sk-" + "a" * 24]


def test_every_pattern_redacts_and_is_idempotent(spark):
    # word boundaries are ASCII: a secret right after a letter with a mark goes too
    rows = [(n, f"{glue}{s} tail") for (n, _), s in zip(R.SECRETS, SECRETS, strict=True) for glue in ("x ", "é", "(")]
    df = spark.createDataFrame(rows, "name string, text string").withColumn("once", R.redact(F.col("text"))).withColumn("twice", R.redact(F.col("once"))).withColumn("hits", R.redaction_hits(F.col("text")))
    for r in df.collect():
        assert f"[REDACTED:{r.name}]" in r.once and r.once == r.twice and r.hits[r.name] == 1, r


def test_extra_patterns_are_validated(spark):
    import pytest

    for bad in (("", "x"), ("jwt_token", "x"), ("e", "x*"), ("m", "REDACTED"), ("m", "jwt_t.ken")):
        with pytest.raises(ValueError):
            R.validated([bad])
    assert _one(spark, R.redact(F.col("t"), [("badge", r"badge-\d+")]), t="my badge-12") == "my [REDACTED:badge]"


def test_keys_refs_and_paths(spark):
    import base64
    import hashlib

    frame = lambda x: len(x.encode()).to_bytes(8, "big") + x.encode()
    want = "sk1_" + hashlib.sha256(frame("m") + frame("pi") + frame("é1")).hexdigest()
    assert _one(spark, S.session_key(F.lit("m"), F.lit("pi"), F.col("s")), s="é1") == want
    enc = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    assert _one(spark, S.message_ref(F.col("a"), F.col("b")), a=want, b="e??>>1") == f"msg:v1:{enc(want)}:{enc('e??>>1')}"
    assert _one(spark, S.path_tokens(F.col("p")), p="/Users/Me/my-app_v2/../Src.go") == sorted({"users", "me", "my-app_v2", "my", "app", "v2", "src.go", "src", "go"})
    for cwd, name in (("/a/b", "b"), ("/a/b/", "b"), ("/", "/"), ("", "")):
        assert _one(spark, S.project_key(F.col("p")), p=cwd) == name
    assert _one(spark, S.truncated_utf8(F.col("t"), 4), t="aéé!") == "aé"
    assert _one(spark, S.parse_ts(F.col("t")), t="2026-01-01") is None
    assert _one(spark, S.parse_ts(F.col("t")), t="2026-01-01T00:00:00Z") is not None


def test_whole_signatures_equal_brute_force(spark, tmp_path):
    import re

    from skein.plans import catalog

    def plain(t):
        for name, pattern in R.SECRETS:
            t = re.sub(pattern, f"[REDACTED:{name}]", t, flags=re.A)
        t = t.lower()
        for pattern, to in R.SIGNATURE:
            t = re.sub(pattern, to, t, flags=re.A)
        return t.strip().encode()[:200].decode(errors="ignore")

    pad = "could not go on with the next of the steps after the first, "
    texts = ["short 12", pad + "see /var/log/x and 42", pad[:55] + "/home/someone/project/file", pad[:50] + "ghp_" + "a1B2" * 9 + " end", pad * 6] + ["x" * n + "é日🙂" * 30 for n in range(190, 203)]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.signature for r in catalog.QUERIES["error_signature_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
