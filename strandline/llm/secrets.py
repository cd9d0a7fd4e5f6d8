"""Secret scans: cheap anchors of all rules as one minimal automaton, which passes over the bytes once; then the spans of the rules whose
anchor was seen, by their whole expressions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import core
from strandline.llm.automaton import SEPARATOR, Automaton

#: What the SQL finds: classes that repeat hold word characters only (but for a web token's). WHOLE finds all of this and more.
RULES = {
    "assigned_token": r"""(?i)\b(?:api[_-]?key|secret|(?:access_|auth_)?token)[ \t]*[:=][ \t]*["'][0-9a-z_]{16,}["']""",
    "aws_access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "aws_secret_key": r"""(?i)\baws_secret_access_key[ \t]*[:=][ \t]*["']?[0-9a-z_]{40}\b""",
    "bearer_token": r"(?i)\bbearer [0-9a-z_]{20,}",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "gitlab_token": r"\bglpat-[0-9A-Za-z_]{20}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_]{35}\b",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+",
    "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "password": r"(?i)\b(?:password|passwd|pwd)[ \t]*[:=][ \t]*[0-9a-z_]{6,}",
    "private_key": r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----",
    "sk_key": r"\bsk-[0-9A-Za-z]{32,}\b",
    "slack_token": r"\bxox[abprs]-[0-9]+-[0-9]+-[0-9A-Za-z]+",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{24,}\b",
    "url_login": r"\b(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[0-9A-Za-z_]+:[0-9A-Za-z_]+@",
}
#: Rule -> (anchor, expression). The anchor is what any match begins with, without counted classes, so that the automaton stays small; the expression,
#: over bytes, has the secret's real alphabet. A value in quotes ends at its own quote, on its line; one without at a space or what closes it.
_NAME, _VALUE = r"(?:api[_-]?key|secret|(?:access_|auth_)?token)", r"(?:password|passwd|pwd)"
_AWS = r"(?:aws_?)?secret_?(?:access_?)?key"
_IS = r"""["']?[ \t]*[:=][ \t]*"""
_LABEL = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?"
WHOLE = {
    "assigned_token": (
        rf"""(?i){_NAME}{_IS}""",
        rf"""(?i)(?<![0-9a-z])(?:[0-9a-z]+[_-]){{0,4}}?{_NAME}{_IS}(?:"[!#-~]{{16,}}"|'[!-&(-~]{{16,}}'|(?=[^\s"']{{0,200}}[0-9])(?=[^\s"']{{0,200}}[a-z])[0-9a-z_.~+/-]{{19,}}[0-9a-z_~+/-]=*)""",
    ),
    "aws_access_key_id": (r"\b(?:AKIA|ASIA)", RULES["aws_access_key_id"]),
    "aws_secret_key": (rf"(?i){_AWS}{_IS}", rf"""(?i)(?<![0-9a-z]){_AWS}{_IS}["']?[0-9a-z/+_]{{40}}(?![0-9a-z/+=_])"""),
    "bearer_token": (r"(?i)\bbearer ", r"(?i)\bbearer [0-9a-z_.~+/-]{19,}[0-9a-z_~+/-]=*"),
    "github_token": (r"\b(?:gh[pousr]|github_pat)_", r"\bgh[pousr]_[0-9A-Za-z]{36}\b|\bgithub_pat_[0-9A-Za-z_]{22,}"),
    "gitlab_token": (r"\bglpat-", r"\bglpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_])"),
    "google_api_key": (r"\bAIza", r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_])"),
    "json_web_token": (r"\beyJ", RULES["json_web_token"]),
    "npm_token": (r"\bnpm_", RULES["npm_token"]),
    "password": (rf"(?i)\b{_VALUE}{_IS}", rf"""(?i)\b{_VALUE}{_IS}(?:"(?:[^"\\\r\n]|\\.){{6,}}"|'(?:[^'\\\r\n]|\\.){{6,}}'|["']?[^\s"'][^\s"]{{4,}}[^\s"'.,;:)\]}}>])"""),
    "private_key": (r"-----BEGIN ", rf"-----BEGIN ({_LABEL})-----(?:(?:(?!-----BEGIN )[\x00-\xff]){{0,20000}}?-----END \1-----|(?:(?:\s|\\r|\\n)*[0-9A-Za-z+/=]{{16,}})*)"),
    "sk_key": (r"\bsk-", r"\bsk-[0-9A-Za-z_-]{32,}"),
    "slack_token": (r"\bxox[abprs]-", r"\bxox[abprs]-[0-9]+-[0-9]+-[0-9A-Za-z-]+"),
    "stripe_key": (r"\b[sr]k_live_", RULES["stripe_key"]),
    "url_login": (r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://", r"""\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^\s/:@"'<>]*:[^\s/"'<>]+@"""),
}
MARK = b"[secret]"


def hits(col: pa.Array, automaton: Automaton):
    """Row -> rules that end in it, for rows with any."""
    found: dict[int, set[int]] = {}
    for lo, hi, data, offs in core.chunks(col):
        mem = memoryview(data)
        joined = np.frombuffer(bytes([SEPARATOR]) + bytes([SEPARATOR]).join(mem[a:b] for a, b in zip(offs[:-1], offs[1:])) + bytes([SEPARATOR]), np.uint8)
        place, state = automaton.ends(joined)
        # A closing \b accepts at the byte after the match, which may be the separator.
        row = np.searchsorted(offs[:-1] + np.arange(1, hi - lo + 1), np.maximum(place - 1, 0), "right") - 1
        for r, s in set(zip(np.clip(row, 0, hi - lo - 1).tolist(), state.tolist())):
            found.setdefault(lo + r, set()).update(automaton.rules[s - automaton.accepting])
    return found


def spans(text: bytes, rules: set[int], compiled: list[re.Pattern]) -> list[tuple[int, int, int]]:
    """(rule, start byte, end byte), leftmost and greedy, without overlaps inside a rule."""
    return [(r, *m.span()) for r in sorted(rules) for m in compiled[r].finditer(text)]


def findings(docs: DataFrame, rules: dict[str, tuple[str, str]] = WHOLE) -> DataFrame:
    """(doc_id, rule, nth, secret_md5, n_chars) of every secret; nth counts from 1 in each row and rule.

    Null and empty texts have none, nor has an empty table; a text of any length is scanned whole; repeated rows are each listed; rules are independent, so that a
    span may be found by two; of matches that begin at one place the rule's leftmost and longest counts. The secret itself is not passed on. Other columns are not read.
    """
    names, automaton = list(rules), Automaton([anchor for anchor, _ in rules.values()])

    def scan(batches):
        compiled = [re.compile(p.encode()) for _, p in rules.values()]
        for batch in batches:
            ids, out = batch["doc_id"], []
            for r, which in sorted(hits(batch["text"], automaton).items()):
                text, count = batch["text"][r].as_py().encode(), {}
                for rule, a, b in spans(text, which, compiled):
                    count[rule] = count.get(rule, 0) + 1
                    out.append((ids[r].as_py(), names[rule], count[rule], hashlib.md5(text[a:b]).hexdigest(), len(text[a:b].decode())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()))], ["doc_id", "rule", "nth", "secret_md5", "n_chars"])

    return core.ids_only(docs, "doc_id", "text").mapInArrow(core.tidy(scan), "doc_id long, rule string, nth int, secret_md5 string, n_chars int")


def redacted(docs: DataFrame, rules: dict[str, tuple[str, str]] = WHOLE) -> DataFrame:
    """docs with every secret in text replaced by [secret]; spans that overlap or touch become one mark.

    All rows and columns stay; n_chars, if there is such a column, counts the new text's characters where it changed. Null and
    empty texts stay as they are, an empty table stays empty; a text of any length is redacted whole.
    """
    core.ship(docs.sparkSession)
    automaton = Automaton([anchor for anchor, _ in rules.values()])
    schema = docs.schema

    def scan(batches):
        compiled = [re.compile(p.encode()) for _, p in rules.values()]
        for batch in batches:
            found = hits(batch.column("text"), automaton)
            if found:
                texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist() if "n_chars" in schema.names else None
                for r, which in found.items():
                    text, out, at = texts[r].encode(), [], 0
                    for _, a, b in sorted(spans(text, which, compiled), key=lambda x: x[1]):
                        if a > at or not out:
                            out += [text[at:a], MARK]
                        at = max(at, b)
                    if not out:
                        continue
                    texts[r] = (b"".join(out) + text[at:]).decode()
                    if sizes:
                        sizes[r] = len(texts[r])
                for name, values in (("text", texts), ("n_chars", sizes)):
                    if values is not None:
                        i = batch.schema.get_field_index(name)
                        batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            yield batch

    return docs.mapInArrow(core.tidy(scan), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return findings(core.read(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same findings by one regular expression function for each rule."""
    quoted = {name: p.replace("'", "''") for name, p in RULES.items()}
    each = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{p}') AS m FROM documents" for name, p in quoted.items())
    return f"""SELECT doc_id, rule, CAST(i AS INTEGER) AS nth, md5(m[i]) AS secret_md5, CAST(length(m[i]) AS INTEGER) AS n_chars
FROM (SELECT doc_id, rule, m, unnest(range(1, len(m) + 1)) AS i FROM ({each}) WHERE len(m) > 0)"""
