"""URL filters: rules, then host word segmentation and naive Bayes.

Host labels are split into words by the most probable segmentation under a unigram
model (Viterbi).  A multinomial naive Bayes model scores host words and path
tokens.  It is trained on labelled site names (TRAINING, or names of one's own).
Tokens that no labelled name holds are learnt from all sites of the table, with the
labels that the labelled names give them, shrunk towards no evidence, so that
tokens which keep company with known ones count too.

A token of the table counts as often as it occurs, damped to log2(1 + n) within a
site, so that a site that holds a third of all pages doesn't drown the others; sums
are exact integers.  Both models are whole tables of counts; they are broadcast while they
are small, else host labels' substrings and tokens are joined with them.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.llm import _spark as S

#: (verdict, host, path) of the rules that the registered query uses.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labelled names of sites by their words: what to block, and what not.
BLOCKED = (
    "online casino bonus; casino bonus win; casino free play; royal casino club; live casino games; lucky slots; free slots; mega slots vegas; slots jackpot; jackpot city win; free spins; sports bets online; bets win; bet now; best betting tips; betting odds today; "
    "poker chips free; online poker room; video poker; roulette wheel; blackjack win; lottery winner; instant lottery; big lotto win; bingo cash; gambling zone; gambling bonus; cheap meds; pills online; diet pills; cheap viagra; viagra shop; cialis pills; "
    "buy viagra online; generic pharma pills; no prescription meds; weight loss pills; payday loans; payday cash; fast cash loans; instant loans; bad credit loans; easy money loans; get rich fast; make money fast; double bitcoin; crypto doubler; free bitcoin; "
    "adult cams; live cams; sex cams; adult video; adult dating; sex dating; hot sex; porn tube; free porn; porn video; nude pics; nude cams; xxx video; xxx tube; escort girls; escort agency; erotic cams; hentai tube; warez download; free warez; crack serial keygen; "
    "keygen download; nulled scripts; torrent warez; malware host; virus download; phish login; phishing kit; verify account login; account suspended verify; ad server; ads tracker; click tracker; ad click track; pixel tracker; popup ads; spam mail blast; "
    "bulk spam; link farm; seo spam links; fake watches; replica watches; cheap replica bags; fake diploma; fake followers; buy followers; buy likes cheap; essay cheat; spy cams; win iphone free; free gift cards; claim prize; prize winner claim; survey prize"
)
ALLOWED = (
    "city library; public library; school library; library books; used books; book shop; children books; daily news; local news; city news; world news today; evening express; sports news; football club; tennis club; swim club; garden seeds; rose garden; garden roses; "
    "flower shop; green farm; organic farm; farm market; fish market; food market; food blog; home recipes; easy recipes; best recipes; bread baker; coffee house; tea house; wine cellar; travel guide; city travel; cheap flights; cheap hotels; hotel booking; mountain hotel; "
    "train times; bus times; car parts; used cars; car repair; bike shop; online shop; shoe shop; toy store; music store; guitar lessons; piano music; free music lessons; video lessons; photo gallery; art gallery; modern art; art school; primary school; language school; "
    "music school; state university; online university; science journal; medical journal; physics forum; open data; data science; weather data; weather today; climate change; health service; health info; city hospital; dental care; eye clinic; family doctor; pharmacy guide; "
    "diet tips; weight training; yoga life; life coach; family law; law office; tax help; tax office; money saving; savings bank; city bank; credit union; home loans guide; student loans office; house prices; real estate; home builder; kitchen design; web design; "
    "free software; open source; cloud host; mail server; game server; video games; board games; chess club; card games; kids games; word games; puzzle games; jobs online; find jobs; job market; small business; business news; stock market; market watch; "
    "dog training; cat care; animal rescue; bird watch; wild life; national park; water works; solar power; wind energy; electric cars; mobile phones; phone shop; computer repair; network tools; link checker; click counter school; account office; gift shop; gift ideas; "
    "wedding photos; dating advice; adult education; adult learning; sex education; win win business; winter sports; track and field; race track; music tracks; prize books; watch repair; watches of switzerland; essay writing help; cash and carry; slot cars; bonus track; big city life; "
    "the daily express; my home page; our town; the art of tea; on the road; time for tea; life in the city; best of the web; new day; one world; black forest; white house; blue sky; red cross; sun rise; star gazing"
)
TRAINING = tuple((label, tuple(x.split())) for label, names in ((1, BLOCKED), (0, ALLOWED)) for x in names.split("; "))
SUBDOMAINS = ("www", "m", "blog", "mobile", "news", "shop")
#: Rows up to which a model is broadcast.
MODEL_ROWS = 1 << 18
#: Letters of the longest unknown word that is weighed as one; known words have any length.
LONGEST_WORD = 20
SALTS = 16
_LETTERS = re.compile(r"[^\W\d_]+")


class Segmenter(dict):
    """Log probabilities of words; unknown words cost by their letters."""

    def __init__(self, counts: dict[str, int], log_total: float | None = None):
        if log_total is None:  # counts are all there are
            log_total = math.log(sum(counts.values()) + 1)
        super().__init__({w: math.log(c) - log_total for w, c in counts.items()})
        self.log_total = log_total
        self.once = {w for w, c in counts.items() if c == 1}
        self.lengths = sorted({*range(1, LONGEST_WORD + 1), *map(len, counts)}, reverse=True)

    def unknown(self, n: int) -> float:
        """A word that isn't in the table: rarer than any that is, the more so the longer it is."""
        return -self.log_total - 2.0 - 1.5 * n

    def split(self, label: str, own=()) -> list[str]:
        """The most probable words of a label; of equally probable ones, the longest last word.

        own: labels of the host itself, which are no words if no other site has them.
        """
        n = len(label)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            # an unknown word may have any length, but only starts where a known one ends or at the front
            for i in (j - k for k in self.lengths if k <= j):
                w = label[i:j]
                known = w in self and not (w in self.once and w in own)
                if not known and j - i > LONGEST_WORD:
                    continue
                s = best[i] + (self[w] if known else self.unknown(j - i))
                if s > best[j]:
                    best[j], back[j] = s, i
        out = []
        while n:
            out.append(label[back[n] : n])
            n = back[n]
        # letters between known words that are no word themselves belong together
        words: list[str] = []
        last_new = False
        for w in reversed(out):
            new = w not in self or w in self.once and w in own
            if words and new and last_new:
                words[-1] += w
            else:
                words.append(w)
            last_new = new
        return words


def _labels(host: str) -> list[str]:
    """Letter runs of a host's labels, without the public suffix and common subdomains."""
    parts = host.split(":")[0].split(".")
    parts = parts[:-1] if len(parts) > 1 else parts
    if parts and parts[0] in SUBDOMAINS:
        parts = parts[1:]
    return [m for p in parts for m in _LETTERS.findall(p)]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of pages(page_id, url): empty where a url is null or has no "://"."""
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(cast(url as string), instr(cast(url as string), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules of it and its parent domains, longest first, as an array."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    found = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(S.small(rules), "rule_host")
    rule = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("rank"), F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    return found.groupBy("host").agg(F.sort_array(F.collect_set(rule)).alias("rules"))


def _is_small(model: DataFrame) -> bool:
    return S.input_bytes(model) <= S.BROADCAST_BYTES and model.limit(min(MODEL_ROWS, S.BROADCAST_ROWS) + 1).count() <= min(MODEL_ROWS, S.BROADCAST_ROWS)


def _salted(rows: DataFrame, model: DataFrame, on: str, how: str) -> DataFrame:
    """rows(host, ...) joined with a model; the model has a copy for each salt, so that no key's rows all meet in one task."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != on]), F.lit(SALTS)).cast("int"))
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(model, [on, "salt"], how).drop("salt")


#: Damped counts are kept as integers, in parts of this.
UNIT = 1024
#: Log odds above which a site labels its tokens as blocked; one at or below 0 labels them as allowed, others don't label.
SURE = math.log(3)
#: Occurrences that the shrinkage of a learnt token is worth.
SHRINK = 4.0


def first_model(training) -> tuple[dict[str, float], float]:
    """(log odds of each word, log odds of the prior) of a multinomial naive Bayes model of labelled names (label, words)."""
    counts, names = ({}, {}), [0, 0]
    for label, words in training:
        names[label] += 1
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
    size = len(counts[0].keys() | counts[1].keys()) + 1
    total = [sum(c.values()) + 0.5 * size for c in counts]
    odds = {w: math.log((counts[1].get(w, 0) + 0.5) / total[1]) - math.log((counts[0].get(w, 0) + 0.5) / total[0]) for w in counts[0].keys() | counts[1].keys()}
    return odds, math.log(names[1] + 0.5) - math.log(names[0] + 0.5)


def url_filter(pages: DataFrame, rules=RULES, training=TRAINING) -> DataFrame:
    """page_id, host, path, rule, verdict, words and block_score for each row of pages(page_id, url, ...).

    rules: (verdict, host, path) triples or a DataFrame(rule_verdict, rule_host,
    rule_path).  The longest rule whose host is the url's or a parent domain, and
    with whose path the url's begins, decides; else naive Bayes, which blocks at a
    block_score (log odds) above 0.  words are the host's segmented words.
    training: (label, words) pairs, label 1 for names to block; it bounds the first
    model, which is sent to all tasks.

    A null or malformed url has an empty host and path and is judged by the prior.
    Repeated rows are judged alike; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    urls = parsed(pages)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "rule_verdict string, rule_host string, rule_path string")
    first_odds, first_prior = first_model(training)
    # all sites and their path tokens, with the number of their urls that hold each
    tokens_of = F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit(r"(\p{L}{2,})")))
    seen = S.written(urls.select("host", "path").distinct().select("host", F.explode_outer(tokens_of).alias("token")).groupBy("host", "token").agg(F.count("*").alias("n")))
    hosts = S.written(seen.select("host").distinct())

    def pieces(batch):
        out = [(h, p) for h in batch.column(0).to_pylist() for p in dict.fromkeys(_labels(h)) if len(p) >= 2]
        yield pa.RecordBatch.from_arrays([pa.array([".".join([x for x in h.split(".") if x not in SUBDOMAINS]) for h, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], names=["site", "piece"])

    words = S.map_arrow(hosts, pieces, "site string, piece string").distinct()
    words = words.union(seen.filter("length(token) >= 2").select("host", "token"))
    words = words.groupBy("piece").agg(F.count("*").alias("n"))
    # words of the labelled names have a count of 2 at least beside what sites give them
    known = {w: 0 for _, ws in training for w in ws}
    for _, ws in training:
        for w in set(ws):
            known[w] += 1
    listed = spark.createDataFrame([(w, max(n, 2)) for w, n in sorted(known.items())], "piece string, least long")
    words = S.written(words.join(F.broadcast(listed), "piece", "full").select("piece", (F.coalesce("n", F.lit(0)) + F.coalesce("least", F.lit(0))).alias("n")))
    log_total = math.log(words.agg(F.sum("n")).first()[0] + 1)
    split_schema = "host string, words array<string>"

    def split(h, segmenter):
        own = _labels(h)
        return [w for p in own for w in segmenter.split(p, own)]

    if _is_small(words):
        shared = spark.sparkContext.broadcast(Segmenter({r["piece"]: r["n"] for r in words.collect()}, log_total))

        def split_all(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([split(h, shared.value) for h in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["host", "words"])

        split_hosts = S.written(S.map_arrow(hosts, split_all, split_schema))
    else:
        lengths = sorted(r[0] for r in words.select(F.length("piece")).distinct().collect())

        def parts(batch):
            for h in batch.column(0).to_pylist():
                out = list({p[i : i + k] for p in _labels(h) for k in lengths if k <= len(p) for i in range(len(p) - k + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(out), pa.string()), pa.array(out, pa.string())], names=["host", "piece"])

        def split_known(batch):
            hs, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ws = [split(h, Segmenter({x["piece"]: x["n"] for x in f or ()}, log_total)) for h, f in zip(hs, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ws, pa.list_(pa.string()))], names=["host", "words"])

        known = _salted(S.map_arrow(hosts, parts, "host string, piece string"), words, "piece", "inner").groupBy("host").agg(F.collect_list(F.struct("piece", "n")).alias("known"))
        split_hosts = S.written(S.map_arrow(hosts.join(known, "host", "left").select("host", "known"), split_known, split_schema))

    def judge(batch):
        scores = [first_prior + sum(first_odds.get(w, 0.0) for w in ws) for ws in batch.column(1).to_pylist()]
        labels = [True if x > SURE else False if x <= 0 else None for x in scores]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.bool_())], names=["host", "words", "bad"])

    judged = S.written(S.map_arrow(split_hosts, judge, split_schema + ", bad boolean").filter("bad is not null"))
    damped = F.round(F.log2(F.col("n") + 1) * UNIT).cast("long").alias("n")
    tokens = judged.select("host", "bad", F.explode("words").alias("token")).groupBy("host", "bad", "token").agg(F.count("*").alias("n"))
    tokens = tokens.union(seen.filter("token is not null").join(S.small(judged.select("host", "bad")), "host").select("host", "bad", "token", "n")).select("bad", "token", damped)
    tokens = tokens.join(F.broadcast(listed.select(F.col("piece").alias("token"))), "token", "left_anti")
    side = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0))
    counts = S.written(tokens.groupBy("token").agg(side(True).alias("b"), side(False).alias("g")))
    sums = counts.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("g"), F.lit(0)).alias("g")).first()
    share = (sums["b"] / UNIT + 1) / ((sums["b"] + sums["g"]) / UNIT + 2)
    learnt = F.log(F.col("b") / UNIT + SHRINK * share) - F.log(F.col("g") / UNIT + SHRINK * (1 - share)) - math.log(share / (1 - share))
    start = first_prior
    given = spark.createDataFrame(sorted(first_odds.items()), "token string, odds double")
    odds = S.written(counts.select("token", learnt.alias("odds")).union(given))

    per_host = S.written(split_hosts.join(_rules_of(hosts, rules), "host", "left"))
    rows = urls.join(S.small(per_host), "host")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    rows = rows.withColumn("pick", F.when(F.size("rules") > 0, F.try_element_at(fits, F.lit(1))))
    tokens = F.concat("words", F.regexp_extract_all(F.lower("path"), F.lit(r"(\p{L}{2,})")))
    columns = ["page_id", "host", "path", F.col("pick.rule").alias("rule"), F.col("pick.rule_verdict").alias("given"), "words"]
    if _is_small(odds):
        log_odds = spark.sparkContext.broadcast({r["token"]: r["odds"] for r in odds.collect()})

        def score(batch):
            get = log_odds.value.get
            out = [start + sum(get(t, 0.0) for t in ts) for ts in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(out, pa.float64())], names=["page_id", "host", "path", "rule", "given", "words", "block_score"])

        rows = S.map_arrow(rows.select(*columns, tokens.alias("tokens")), score, "page_id long, host string, path string, rule string, given string, words array<string>, block_score double")
    else:
        each = rows.select("host", "path", tokens.alias("tokens")).distinct().select("host", "path", F.explode("tokens").alias("token"))
        sums = _salted(each, odds, "token", "inner").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
        rows = rows.select(*columns).join(sums, ["host", "path"], "left").withColumn("block_score", F.coalesce("odds", F.lit(0.0)) + start)
    verdict = F.coalesce("given", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "block_score")
