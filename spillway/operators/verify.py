"""Verification without contact: routing, response matching, verdicts, lints (JN-10, JN-18, VER-01 to VER-03).

What is here decides which verifier a finding goes to and what responses say of it.
Requests are only made by probed(), through a function that the caller hands over.
"""

from __future__ import annotations

import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.detect.dialect import translate

STOPWORDS = tuple(sorted("access api api- api_ api_key apikey app auth client key key- key_ live password pk pk_ secret sk sk- sk_ test token".split()))

#: id and anchors of the verifiers that are known.
CATALOGUE = {
    line.split()[0]: tuple(line.split()[1:])
    for line in """
airtable airtable
anthropic anthropic sk-ant- sk-ant-api03- sk-ant-admin01-
asana asana
assemblyai assemblyai
aws aws akia asia
bitbucket bitbucket atctt
brevo brevo xkeysib sendinblue
bugsnag bugsnag
buildkite buildkite
calendly calendly calendly-personal-token
circleci circleci
clickup clickup pk_ clickup-api-token
cloudflare cloudflare
cohere cohere
coinbase-commerce coinbase
contentful contentful CFPAT-
datadog datadog
deepgram deepgram
digitalocean digitalocean dop_v1_
discord discord
dropbox dropbox
elevenlabs elevenlabs
fastly fastly
figma figma
front front
github github ghp_ gho_ ghr_ ghs_ ghu_
gitlab gitlab glpat
google-api-key gemini google-api-key google-gemini-api-key
grafana grafana glc_
groq groq gsk_
heroku heroku
honeycomb honeycomb
hubspot hubspot pat-eu pat-na hubspot-private-app-token
huggingface huggingface hf_ api_org_
intercom intercom
langsmith langsmith ls__ lsv2_
launchdarkly launchdarkly api-
linear linear lin_api
linode linode
loops loops
mailchimp mailchimp -us
mailgun mailgun
mistral mistral
mollie mollie
netlify netlify
newrelic newrelic nrak
notion notion
npm npm
openai openai t3blbkfj sk-admin- sk-proj- sk-svcacct-
openrouter openrouter sk-or-v1-
opsgenie opsgenie
pagerduty pagerduty
paystack paystack
pinecone pinecone pcsk_
plaid plaid
planetscale planetscale pscale_tkn_
postmark postmark
razorpay razorpay rzp_live
replicate replicate r8_
resend resend re_
rollbar rollbar
sendgrid sendgrid
sentry sentry sntrys_
slack slack xoxa xoxb xoxp
snyk snyk
sparkpost sparkpost
spotify spotify
square square EAAA sq0atp
stability stability
stripe stripe
supabase supabase sb_secret_ service_role
telegram telegram
terraform terraform atlasv1
together together
travisci travis
twilio twilio
vercel vercel
vultr vultr
yandex-apikey yandex aje aqvn
yandex-iam yandex t1. yc_
""".strip().splitlines()
}


def anchors(spark: SparkSession, verifiers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """ord, id, anchor: a row for each anchor, in lower case."""
    rows = [(k, v.lower(), a.lower()) for k, (v, many) in enumerate((verifiers or CATALOGUE).items()) for a in many if a]
    return spark.createDataFrame(rows, "ord int, verifier string, anchor string")


def _score(kind: Column, value: Column, id: Column, anchor: Column) -> Column:
    stop = anchor.isin(*STOPWORDS)
    alnum = F.char_length(F.regexp_replace(anchor, "[^a-z0-9]", ""))
    n = F.octet_length(anchor)
    separator = anchor.rlike(r"[-_.]")
    by_type = F.contains(kind, anchor) & ~stop & (F.contains(id, anchor) | F.contains(anchor, id) | (alnum >= 5))
    first = F.startswith(value, anchor) & (separator | (alnum >= 3))
    middle = (n >= 6) | (separator & (alnum >= 3)) | ((alnum >= 4) & ~anchor.rlike(r"^[-_.]"))
    by_value = F.contains(value, anchor) & ~stop & (first | middle)
    return F.when(by_type, 1000 + n).when(by_value, n)


def route(rows: DataFrame, anchors: DataFrame, key: str = "finding_id") -> DataFrame:
    """key and verifier of each row of key, type and value that some verifier can test.

    A type decides before a value, a longer anchor before a shorter one, an earlier verifier
    before a later one.  The anchors are the rule table, a few hundred rows whatever the corpus.
    """
    return routed(rows, anchors).where("verifier IS NOT NULL").groupBy(key).agg(F.max_by("verifier", F.struct("__score", "__ord")).alias("verifier"))


def routed(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows with their verifier, null if there is none, and __score and __ord, by which it was chosen; a narrow pass."""
    each = anchors.agg(F.collect_list(F.struct("anchor", "verifier", "ord")).alias("__anchors"))
    low = rows.crossJoin(F.broadcast(each)).withColumns({"__t": F.lower("type"), "__v": F.lower("value")})
    # No anchor holds a NUL, so one search in both is a search in each.
    held = F.filter("__anchors", lambda a: F.contains(F.concat_ws("\0", "__t", "__v"), a["anchor"]))
    score = lambda a: _score(F.col("__t"), F.col("__v"), a["verifier"], a["anchor"])
    best = F.array_max(F.filter(F.transform("__held", lambda a: F.struct(score(a).alias("score"), (-a["ord"]).alias("ord"), a["verifier"].alias("verifier"))), lambda x: x["score"].isNotNull()))
    out = low.withColumn("__held", held).withColumn("__best", F.when(F.size("__held") > 0, best))
    return out.select(*rows.columns, F.col("__best.verifier").alias("verifier"), F.col("__best.score").alias("__score"), F.col("__best.ord").alias("__ord"))


@dataclass(frozen=True)
class ResponseMatcher:
    type: str
    status: tuple[int, ...] = ()
    words: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    part: str = "body"
    condition: str = "or"
    negative: bool = False


def response_ok(matchers: tuple[ResponseMatcher, ...], any_of: bool = False, status: str = "status", body: str = "body", headers: str = "headers") -> Column:
    """Whether a response shows a live credential; without matchers any 2xx does."""
    code = F.col(status)
    if not matchers:
        return F.coalesce(code.between(200, 299), F.lit(False))
    head = F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    tests = []
    for m in matchers:
        text = head if m.part.lower() == "header" else F.col(body)
        each = [code == c for c in m.status] if m.type == "status" else [F.contains(text, F.lit(w)) for w in m.words] if m.type == "word" else [text.rlike(translate(r, java=True)) for r in m.regex]
        ok = F.lit(bool(each) and (m.condition == "and"))
        for k, e in enumerate(each):
            e = F.coalesce(e, F.lit(False))
            ok = e if not k else (ok & e if m.condition == "and" and m.type != "status" else ok | e)
        tests.append(~ok if m.negative else ok)
    out = tests[0]
    for t in tests[1:]:
        out = out | t if any_of else out & t
    return out


def verdicts(responses: DataFrame, live: Column, key: str = "finding_id") -> DataFrame:
    """key, verified, rationale.  responses: key, verifier, status, error, body, headers, capability (of the request, or null).

    Live: a request without capability that matches.  Rate limits, server errors and failures
    are inconclusive.  Capabilities of matching requests are what the credential unlocks.
    """
    unsure = F.col("error").isNotNull() | F.col("status").isin(408, 425, 429) | (F.col("status") >= 500)
    rows = responses.withColumns({"__live": live & ~unsure, "__unsure": unsure, "__main": F.col("capability").isNull()})
    got = rows.groupBy(key).agg(
        F.first("verifier").alias("verifier"), F.bool_or(F.col("__main") & F.col("__live")).alias("ok"), F.bool_or(F.col("__main") & F.col("__unsure")).alias("unsure"),
        F.array_sort(F.collect_set(F.when(F.col("__live"), F.col("capability")))).alias("unlocks"),
    )
    verified = F.when(F.col("ok"), True).when(F.col("unsure"), F.lit(None).cast("boolean")).otherwise(False)
    note = F.when(F.size("unlocks") > 0, F.concat(F.lit(" (unlocks: "), F.array_join("unlocks", ", "), F.lit(")"))).otherwise("")
    why = F.when(F.col("ok"), F.concat(F.lit("live by "), "verifier", note)).when(F.col("unsure"), F.concat(F.lit("inconclusive by "), "verifier")).otherwise(F.concat(F.lit("rejected by "), "verifier"))
    return got.select(key, verified.alias("verified"), why.alias("rationale"))


def context_values(rows: DataFrame, extract: dict[str, str]) -> DataFrame:
    """Secondary values from an item's text, for each name and pattern; null where there is none."""
    def one(rx: str) -> Column:
        grouped = re.compile(translate(rx)).groups
        got = F.regexp_extract("text", translate(rx, java=True), 1 if grouped else 0)
        return F.when(got != "", got)

    return rows.withColumns({name: one(rx) for name, rx in extract.items()})


def leaks_secret(url: str, signed: bool = False) -> bool:
    """Whether a request of an unsigned set puts the secret into its URL."""
    return not signed and re.search(r"\{\{[^}]*\bsecret\b[^}]*\}\}", url) is not None


def may_contact(hosts: DataFrame) -> DataFrame:
    """Hosts that aren't internal: no loopback, private, link-local, shared, multicast or metadata addresses."""
    v4 = r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(?:22[4-9]|2[3-5][0-9])\.|^198\.1[89]\.|^192\.0\.0\."
    v6 = r"(?i)^\[?(?:::1?\]?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:)"
    inner = F.regexp_extract("host", r"(?i)^\[?(?:::ffff:|64:ff9b::)([0-9.]+)", 1)
    internal = F.col("host").rlike(v4) | inner.rlike(v4) | F.col("host").rlike(v6) | F.lower("host").rlike(r"^localhost\.?$|\.(?:internal|local|localhost)\.?$")
    return hosts.where(~F.coalesce(internal, F.lit(True)))


CONCURRENT, AGAIN = 8, (429, 503)


def probed(requests: DataFrame, fetch, key: str = "finding_id", concurrent: int = CONCURRENT, pause: float = 1.0) -> DataFrame:
    """Responses, as verdicts() takes them.  requests: key, verifier, capability, method, url, headers (a map) and body.

    fetch(method, url, headers, body) gives (status, headers, body).  Equal requests are made
    once, whatever the number of findings; in a partition so many are under way at a time, and
    one that is told to wait is made once more.  A failure is a row with its error.
    """
    what = ["verifier", "capability", "method", "url", "headers", "body"]
    rows = requests.withColumn("__q", F.sha2(F.to_json(F.struct("method", "url", F.array_sort(F.map_entries("headers")), "body")), 256))
    once = rows.groupBy("__q").agg(*(F.first(c, ignorenulls=False).alias(c) for c in what))

    def one(r) -> tuple:
        q, method, url, headers, body = r
        for turn in (0, 1):
            try:
                status, head, text = fetch(method, url, dict(headers or ()), body)
            except Exception as e:
                return q, None, f"{type(e).__name__}: {e}"[:200], None, None
            if status not in AGAIN or turn:
                return q, status, None, text, dict(head)
            time.sleep(pause)

    def run(batches):
        with ThreadPoolExecutor(concurrent) as pool:
            for batch in batches:
                got = list(pool.map(one, zip(*(batch.column(k).to_pylist() for k in range(5)))))
                if got:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*got), kinds)], ["__q", "status", "error", "body", "headers"])

    answers = once.select("__q", "method", "url", "headers", "body").mapInArrow(run, "__q string, status int, error string, body string, headers map<string,string>")
    return rows.select(key, "verifier", "capability", "__q").join(answers, "__q").select(key, "verifier", "status", "error", "body", "headers", "capability")
