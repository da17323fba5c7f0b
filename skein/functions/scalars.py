"""Keys, references, tokens, times and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def parse_ts(text: Column) -> Column:
    """The instant of an RFC 3339 text; null for any other text."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval, between 0 and 1; 0 without trials."""
    n = trials.cast("double")
    p = successes / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(trials <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centre - margin) / (1 + z * z / n))))


def spread(sessions: Column, projects: Column) -> Column:
    """1 for one session of one project, one more for each further session and half for each further project."""
    return F.greatest(F.lit(0.0), F.lit(1.0) + (sessions - 1) + F.lit(0.5) * (projects - 1))


def project_key(cwd: Column) -> Column:
    """The last part of a path; `/` for the root, empty for none."""
    bare = F.regexp_replace(cwd, "/+$", "")
    return F.when(F.coalesce(cwd, F.lit("")) == "", "").when(bare == "", "/").otherwise(F.element_at(F.split(bare, "/"), -1))


def path_tokens(path: Column) -> Column:
    """Distinct sorted parts of a path, and the parts of these between - _ . space and tab."""
    parts = F.split(F.lower(F.trim(path)), "/")
    every = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, r"[-_. \t]"))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: ~t.isin("", ".", ".."))))


def _framed(text: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")), text.cast("binary"))


def session_key(machine: Column, source: Column, session: Column) -> Column:
    """sk1_ and the SHA-256 of the three texts, each behind its length in eight bytes."""
    return F.concat(F.lit("sk1_"), F.sha2(F.concat(_framed(machine), _framed(source), _framed(session)), 256))


def base64url(text: Column) -> Column:
    """Base 64 with the URL alphabet, without padding and line breaks."""
    plain = F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


#: A session's reference, or with a second part a message's.
MESSAGE = r"^(?:session:v1:(?=[^:]*\z)|msg:v1:(?=[^:]*:[^:]*\z))([A-Za-z0-9_-]*):?([A-Za-z0-9_-]*)\z"


def message_ref(session: Column, entry: Column) -> Column:
    return F.concat(F.lit("msg:v1:"), base64url(session), F.lit(":"), base64url(entry))


def session_ref(session: Column) -> Column:
    return F.concat(F.lit("session:v1:"), base64url(session))


def artifact_ref(sha: Column) -> Column:
    return F.concat(F.lit("artifact:v1:"), sha)


def parsed_ref(ref: Column) -> Column:
    """struct(kind, session_key, entry_id, artifact_sha256) of a reference; null for what is none.

    A session's key is sk1_ and 64 hexadecimal digits in lower case, an entry's id has a letter that is no white space
    and neither zero byte nor line break, base 64 is that of URLs without padding and holds text.
    """
    def decoded(group: int) -> Column:
        plain = F.translate(F.regexp_extract(ref, MESSAGE, group), "-_", "+/")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    def made(kind: str, session: Column | None = None, entry: Column | None = None, sha: Column | None = None) -> Column:
        parts = zip(("session_key", "entry_id", "artifact_sha256"), (session, entry, sha), strict=True)
        return F.struct(F.lit(kind).alias("kind"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in parts])

    session, entry = decoded(1), decoded(2)
    known = session.rlike(r"^sk1_[0-9a-f]{64}\z")
    named = entry.rlike(r"(?U)\S") & ~entry.rlike(r"[\x00\n\r]")
    return (F.when(ref.rlike(MESSAGE) & ref.startswith("msg:") & known & named, made("message", session, entry))
            .when(ref.rlike(MESSAGE) & ref.startswith("session:") & known, made("session", session))
            .when(ref.rlike(r"^artifact:v1:[0-9a-f]{64}\z"), made("artifact", sha=F.substring(ref, 13, 64))))


def truncated_utf8(text: Column, most: int) -> Column:
    """At most `most` bytes of text, cut back to a whole character."""
    raw = text.cast("binary")
    cuts = F.array(*[F.try_validate_utf8(F.substring(raw, 1, most - back).cast("string")) for back in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.get(F.filter(cuts, lambda c: c.isNotNull()), F.lit(0)))


def sniff_media(content: Column) -> Column:
    """Media type by leading bytes: png, gif, jpeg, webp; empty otherwise."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise("")
