"""Personal data by weak supervision, in DataFrame functions only.

Base patterns always count. Much looser patterns propose further spans. On every
candidate, base ones too, six labelers vote 1, -1 or 0 (abstain): a strict form, a
check of its digits or characters, a gazetteer, words before it that speak for the
kind, words before it that speak against, and what follows. No labeler knows
whether a span is a base one. The counts of the vote patterns over all documents
are all that EM needs (Dawid & Skene, 1979) to estimate every labeler's
reliability for each kind, and all that the final logistic classifier is trained
on. Those counts have a fixed bound: kinds x 729 votes x ``BUCKETS``, whatever the
corpus. The classifier's verdict for each pattern goes back into the plan as a
literal list.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._shared import bound, saved, unused

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> a pattern that finds what the plain pattern finds, without backtracking over long runs
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: looser proposals, kind -> pattern: any run of 7 to 15 digits, any long token, titles with a name and any two capitalised words;
#: most of them are nothing personal, so that the labelers' errors can be told
LOOSE = {
    "phone": r"(?<![0-9A-Za-z+.(-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "secret": r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{16,}+",
    "name": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|[A-Z][a-z]+)\x20[A-Z][a-z]+(?![A-Za-z])",
}
KINDS = ["email", "ip", "card", "phone", "ssn", "secret", "name"]
LABELERS = ["form", "check", "gazetteer", "for", "against", "after"]
BUCKETS = 4  # of a candidate's length
#: a cheap condition on the text that a pattern needs
_NEEDS = {"email": "instr(text, '@') > 0", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9]([\\x20-]?[0-9]){12}'", "phone": "instr(text, '+') > 0", "loose_phone": r"text rlike '[0-9]([\\x20().-]{0,2}[0-9]){6}'", "ssn": "text rlike '[0-9]{3}-[0-9]'", "secret": "text rlike '[0-9A-Za-z_-]{16}'", "name": r"text rlike '([a-z]|[MDP][rs]*\\.) [A-Z][a-z]'"}
#: fixed values: words before a span that speak for a kind, and such that speak against any
CUES = {"email": "mail|contact|write|reach", "ip": "ip|address|host|server|login", "card": "card|visa|credit|pay", "phone": "call|phone|tel|fax|mobile", "ssn": "ssn|social|security", "secret": "token|key|secret|password|passwd|auth|bearer", "name": "by|from|contact|dear|signed"}
AGAINST = "version|isbn|page|order|chapter|section|item|sku|commit|sha|hash|checksum|md5|uuid|build|example|sample"
#: fixed values: public top domains, area codes that aren't personal, common family names, country codes of large countries, card numbers of manuals
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|it|nl|pl|ru|cn|jp|in|br|ca|au|ch|at|be|se|dev|me|co"
FREE_CODES = "800|888|877|866|855|844|833|822"
NAMES = (
    "Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Garcia|Wilson|Anderson|Taylor|Thomas|Moore|Martin|Jackson|Thompson|White|Lee|Harris|Clark|Lewis|Robinson|Walker|Young|Allen|King|Wright|Scott|Hill|Green|Adams|Baker|Nelson|Carter|"
    "Mitchell|Roberts|Turner|Phillips|Campbell|Parker|Evans|Edwards|Collins|Schmidt|Schneider|Fischer|Weber|Meyer|Wagner|Becker|Schulz|Hoffmann|Dubois|Bernard|Petit|Durand|Leroy|Moreau|Simon|Laurent|Lopez|Martinez|Gonzalez|Rodriguez|"
    "Fernandez|Perez|Sanchez|Ramirez|Torres|Flores|Rivera|Gomez|Diaz|Rossi|Russo|Ferrari|Silva|Santos|Oliveira|Novak|Kowalski|Ivanov|Nguyen|Chen|Wang|Zhang|Kim|Patel|Singh|Khan"
)
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|George|Edward|Peter|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Anna|Laura|"
    "Emma|Maria|Jane|Alice|Julia|Sophie|Hans|Klaus|Stefan|Andreas|Monika|Petra|Pierre|Jean|Marie|Claire|Luc|Carlos|Juan|Jose|Luis|Carmen|Ana|Marco|Paolo|Giulia|Olga|Ivan|Wei|Li|Yuki|Ali|Fatima"
)
COUNTRIES = "1|7|20|27|30|31|32|33|34|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
MANUAL_CARDS = "4111111111111111|4242424242424242|5555555555554444|378282246310005"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0))
        luhn = bound(digits, lambda d: F.aggregate(F.transform(F.split(F.reverse(d), "(?!^)(?!$)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0)
        return F.when(F.length(digits).between(13, 19), luhn).otherwise(False)
    return F.lit(True)


_BLOCK = 256


def _spans(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of the pattern's matches: kind, start, end (code points), match, base, and up to 30 characters of the gaps before and after.

    Starts follow from the lengths of matches and of the pieces between them,
    summed over blocks of matches first, so that a long text costs little more
    than its length.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def place(x: Column) -> Column:
        widths = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["gap"], i)))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

        def lay(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(w, b * _BLOCK + 1, _BLOCK)))
            start = lambda i, own: total(F.slice(own, 1, F.floor(i / _BLOCK).cast("int"))) + total(F.slice(w, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + F.length(F.get(x["gap"], i))
            return bound(blocks, lambda own: F.transform(x["m"], lambda m, i: F.struct(start(i, own).alias("start"), m.alias("match"), F.right(F.get(x["gap"], i), F.lit(30)).alias("before"), F.left(F.get(x["gap"], i + 1), F.lit(30)).alias("after"))))

        return F.when(F.size(x["m"]) > 0, bound(widths, lay)).otherwise(F.array().cast("array<struct<start:int,match:string,before:string,after:string>>"))

    found = F.filter(bound(parts, place), lambda s: _valid(kind, s["match"]) if base else F.lit(True))
    return F.transform(
        found,
        lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match"), F.lit(base).alias("base"), s["before"].alias("before"), s["after"].alias("after")),
    )


_SPAN = "array<struct<kind:int,start:int,end:int,match:string,base:boolean,before:string,after:string>>"


def _candidates(text: Column) -> Column:
    none = F.array().cast(_SPAN)
    base = [F.when(F.expr(_NEEDS[k]), _spans(text, p, k, True)).otherwise(none) for k, p in BASE.items()]
    loose = [F.when(F.expr(_NEEDS["loose_phone" if k == "phone" else k]), _spans(text, p, k, False)).otherwise(none) for k, p in LOOSE.items()]
    apart = lambda s, sure: ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return bound(F.concat(*base), lambda sure: F.concat(sure, F.filter(F.concat(*loose), lambda s: apart(s, sure))))


def _votes(s: Column) -> Column:
    """The labelers' votes and the length bucket of a candidate, as one number."""
    kind, m, before, after = s["kind"], s["match"], F.lower(s["before"]), s["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    sign = lambda yes: F.when(yes, 1).otherwise(-1)

    def by_kind(votes: dict[str, Column], rest: Column | int = 0) -> Column:
        out = F.lit(rest) if isinstance(rest, int) else rest
        for k, v in votes.items():
            out = F.when(kind == KINDS.index(k), v).otherwise(out)
        return out

    form = by_kind({
        "email": sign(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9]+-?)+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") & ~m.contains("..")),
        "ip": sign(m.rlike(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$")),
        "card": sign(m.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}[\x20-]?[0-9]*|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")),
        "phone": sign((m.startswith("+") | m.rlike(r"[^0-9]")) & m.rlike(r"^(?:\+[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}$")),
        "ssn": F.lit(1),
        "secret": sign(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,})$")),
        "name": sign(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b")),
    })
    check = by_kind({
        "email": sign(F.length(m) <= 80),
        "ip": sign(~m.rlike(r"^(?:0|10|127|192\.168|169\.254|22[4-9]|2[3-5][0-9])\.")),
        "card": sign(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)") & F.length(digits).isin(15, 16)),
        "phone": sign((m.startswith("+") | m.rlike("[^0-9]")) & F.length(digits).between(10, 13) & ~digits.rlike(r"([0-9])\1{6}")),
        "ssn": sign(~m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "secret": sign((F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 10) & (F.length(digits) >= 4) & (F.length(digits) < F.length(m))),
        "name": F.when(m.rlike(r"^([A-Za-z]+)\x20\1$"), -1).otherwise(0),
    })
    listed = by_kind({
        "email": sign(m.rlike(rf"(?i)\.({TOP_DOMAINS})$")),
        "ip": F.when(m.isin("8.8.8.8", "1.1.1.1", "1.2.3.4", "255.255.255.0", "0.0.0.0"), -1).otherwise(0),
        "card": F.when(digits.rlike(f"^(?:{MANUAL_CARDS})$"), -1).otherwise(0),
        "phone": F.when(m.rlike(rf"^(?:\+1[\x20.-]?)?\(?({FREE_CODES})\)?[^0-9]"), -1).when(m.startswith("+"), sign(m.rlike(rf"^\+(?:{COUNTRIES})"))).when(~m.rlike("[^0-9]"), 0).otherwise(sign(~m.rlike(r"^\(?[01]") & ~m.rlike(r"^(?:19|20)[0-9]{2}[-.][01]?[0-9][-.][0-3]?[0-9]$"))),
        "ssn": F.when(m.isin("078-05-1120", "123-45-6789", "219-09-9999"), -1).otherwise(0),
        "name": sign(m.rlike(rf"(?:^({GIVEN}) | ({NAMES})$)")),
    })
    cue = F.when(by_kind({k: before.rlike(rf"(^|[^a-z])({words})") for k, words in CUES.items()}, F.lit(False)), 1).otherwise(0)
    against = F.when(before.rlike(rf"({AGAINST})[^a-z]*$"), -1).otherwise(0)
    follows = F.when(after.rlike("^(?:[0-9A-Za-z_@/%]|[.:=-][0-9A-Za-z])"), -1).when(after.rlike(r"^(?:[\x20,;.:!?)>\"'\]\n]|$)"), 1).otherwise(0)
    code = kind
    for v in (form, check, listed, cue, against, follows):
        code = code * 3 + v + 1
    return (code * BUCKETS + F.least(F.floor(F.length(m) / 12), F.lit(BUCKETS - 1))).cast("int")


def _unpack(code: int) -> tuple[int, list[int], int]:
    code, bucket = divmod(code, BUCKETS)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], bucket


def fit(counts: dict[tuple[int, bool], int], rounds: int = 50) -> tuple[set[int], dict]:
    """EM over vote patterns, then logistic regression on its posteriors: the codes accepted, and the estimates.

    ``counts``: (code, base) -> candidates, at most kinds x 3^labelers x BUCKETS x 2.
    Kinds have a prior and reliabilities of their own; those have a weak prior of
    labelers that are more often right than wrong.
    """
    if not counts:
        return set(), {"prior": {}, "reliability": {}, "weights": [], "accept": {}}
    codes = [c for c, _ in counts]
    n = np.array([*counts.values()], float)
    kinds, votes, buckets = (np.array(x) for x in zip(*map(_unpack, codes), strict=True))
    post = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))  # the majority starts
    priors, tables = {}, {}
    for k in np.unique(kinds):
        own = kinds == k
        v, m, p = votes[own], n[own], post[own]
        for _ in range(rounds):
            prior = (1 + (m * p).sum()) / (2 + m.sum())
            table = np.array([[[(1 + (m * side * (v[:, j] == x)).sum() + 2 * (x * sign == 1)) / (5 + (m * side).sum()) for x in (-1, 0, 1)] for side, sign in ((1 - p, -1), (p, 1))] for j in range(len(LABELERS))])
            score = math.log(prior / (1 - prior)) + sum(np.log(table[j, 1, v[:, j] + 1] / table[j, 0, v[:, j] + 1]) for j in range(len(LABELERS)))
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        post[own], priors[KINDS[k]], tables[KINDS[k]] = p, float(prior), table[:, [0, 1], [0, 2]].tolist()
    one_hot = lambda x, values: (x[..., None] == np.array(values)).reshape(len(x), -1)
    x = np.hstack([np.ones((len(n), 1)), one_hot(votes, (-1, 1)), one_hot(kinds, range(len(KINDS))), one_hot(buckets, range(BUCKETS))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (post - p)) - w)
    accept = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {c for c, a in zip(codes, accept, strict=True) if a >= 0.5}, {"prior": priors, "reliability": tables, "weights": w.tolist(), "accept": dict(zip(codes, accept.tolist(), strict=True))}


def _with_candidates(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with, as ``name``, all candidates of the text (null: none) and their codes."""
    coded = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _votes(s).alias("code"))
    return docs.withColumn(name, bound(_candidates(F.col("text")), lambda a: F.transform(a, coded)))


def accepted_codes(found: DataFrame, name: str = "found") -> set[int]:
    counts = found.where(F.size(name) > 0).select(F.explode(name).alias("s")).groupBy("s.code", "s.base").count()
    return fit({(r["code"], r["base"]): r["count"] for r in counts.collect()})[0]  # bounded: see fit


def _final(found: Column, codes: set[int]) -> Column:
    """Base spans and accepted ones, by kind and start."""
    own = F.filter(found, lambda s: s["base"] | (s["code"].isin(sorted(codes)) if codes else F.lit(False)))
    return F.array_sort(F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind int, start, end, base>>``, one row per input row; kinds are places in KINDS.

    Spans are code points, end exclusive, sorted by kind and start. A null or
    empty text has no spans; repeated rows are scanned each on its own and count
    each in EM; an empty table gives none. Vote patterns that tie at one half are
    accepted. Other columns are ignored.
    """
    found = saved(_with_candidates(docs.select("doc_id", "text"), "found").select("doc_id", "found"))
    return found.select("doc_id", _final(F.col("found"), accepted_codes(found)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """Replace every span by its kind in capitals, as ``[EMAIL]``; overlapping spans become one, of the first kind.

    Keeps all columns, whatever their names; ``n_chars`` follows the new text; texts
    without spans, null ones too, stay as they are. The candidates are found once
    and written with the rows. An empty table gives none.
    """
    name = unused(docs, "found")
    rows = saved(_with_candidates(docs, name))
    spans = F.array_sort(F.transform(_final(F.col(name), accepted_codes(rows, name)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(tags, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    def cut(own: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(own, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))

    changed = F.transform(F.array(spans), lambda own: F.when(F.size(own) > 0, cut(own)))[0]
    new = unused(rows, "new")
    rows = rows.withColumn(new, changed)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c.lower() == "text":
            columns[i] = F.coalesce(F.col(new), F.col("text")).alias(c)
        if c.lower() == "n_chars":
            columns[i] = F.when(F.col(new).isNotNull(), F.length(new).cast(dict(docs.dtypes)[c])).otherwise(F.col(f"`{c}`")).alias(c)
    return rows.select(*columns)
