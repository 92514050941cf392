"""Words of Korean prose as Column expressions: particles, verb tails, topics, noun runs, register, index tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.functions.text import word_array

#: Particles, tails of verbs, words that are no topic.
PARTICLES = "에서는 으로는 에게는 까지는 부터는 보다는 으로부터 로부터 으로써 으로서 이라고 이라는 이라도 이라면 에서 에게 께서 까지 부터 보다 처럼 만큼 으로 조차 마저 밖에 이나 이란 이든 라고 라는 라도 로써 로서 은 는 이 가 을 를 의 에 로 와 과 도 만 께 야 랑 나 든".split()
VERB_TAILS = "습니다 입니다 됩니다 합니다 니다 십시오 합시다 봅시다 세요 어요 아요 해요 지요 까요 나요 였다 이다 었다 았다 한다 된다 는다 하며 하고 하여 해서 되어 려면 도록 니까 므로 지만 는데 하는 되는 있는 없는 같은 위한 대한 관한 통한 죠 다 고 며 서 면 게 기 한 할 된 될 돼 던 껏 히 는지 른 로운 라운 려운 거운 벼운 러운 쉬운".split()
STOPWORDS = "이 그 저 것 수 등 때 및 또 더 좀 잘 못 안 왜 곧 다시 이제 지금 여기 거기 어디 무엇 누가 전부 모두 매우 아주 너무 바로 그냥 정말".split()
#: Marks at the edges of words, what closes a clause, what opens a bracket, a number with a unit.
EDGE = r"[^가-힣A-Za-z0-9]+"
CLOSES = r"[,.?!:;)\]]$"
OPENS = r"^[(\[\"'“‘「『]"
QUANTITY = "^제?[0-9][0-9,.]*[가-힣]{1,3}$"
#: Endings of the registers of a sentence's last word.
REGISTERS = [("합니다", "(니다|니까|십시오)$"), ("해요", "(요|죠)$"), ("한다", "(다|까|라|자)$")]
MIXED, NO_REGISTER = "섞임", "없음"


def core(word: Column) -> Column:
    """A word without the marks at its edges."""
    return F.regexp_replace(word, f"^{EDGE}|{EDGE}$", "")


def tail_of(word: Column, tails: list[str]) -> Column:
    """The longest tail that is shorter than the word; '' without one. A lazy start leaves the longest tail."""
    return F.regexp_extract(word, f"^.+?({'|'.join(tails)})$", 1)


def strip_particle(word: Column, particles: list[str] | None = None) -> Column:
    """A word of Hangul without one particle."""
    return F.regexp_replace(word, f"^(.*?[가-힣A-Za-z0-9])(?:{'|'.join(particles or PARTICLES)})$", "$1")


def is_hangul(word: Column) -> Column:
    return word.rlike("^[가-힣]+$")


def words(text: Column) -> Column:
    """Words in order as struct(core, ends_clause, opens, particle)."""
    struct = lambda w: F.struct(core(w).alias("core"), w.rlike(CLOSES).alias("ends_clause"), w.rlike(OPENS).alias("opens"), (is_hangul(core(w)) & (tail_of(core(w), PARTICLES) != "")).alias("particle"))
    return F.filter(F.transform(word_array(F.coalesce(text, F.lit(""))), struct), lambda w: w["core"] != "")


def topics(text: Column) -> Column:
    """Distinct words without particles in lower case, in order of the alphabet; no stop words, single letters, verbs."""
    stems = F.transform(words(text), lambda w: F.lower(strip_particle(w["core"])))
    keep = lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS) & (~is_hangul(t) | (tail_of(t, VERB_TAILS) == "")) & t.rlike("[가-힣A-Za-z]")
    return F.array_sort(F.array_distinct(F.filter(stems, keep)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united members; 0 where a side is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def is_bare_noun(word: Column, non_nouns: list[str]) -> Column:
    """No particle and no verb's tail; what is not Hangul counts as a noun."""
    return F.when(~is_hangul(word), word.rlike("^[가-힣A-Za-z0-9]+$")).otherwise((tail_of(word, PARTICLES) == "") & (tail_of(word, VERB_TAILS) == "") & ~word.isin(non_nouns))


def longest_noun_run(text: Column, non_nouns: list[str]) -> Column:
    """Words of the longest run of bare nouns; numbers and quantities are passed over, ASCII words in a row count once."""
    kind = lambda w: F.when(w["core"].rlike("^[0-9]+$") | w["core"].rlike(QUANTITY), F.lit("-")).when(~is_bare_noun(w["core"], non_nouns), F.lit(" ")).when(w["core"].rlike("^[A-Za-z0-9]+$"), F.lit("a")).otherwise(F.lit("n"))
    line = F.array_join(F.transform(words(text), lambda w: F.concat(F.when(w["opens"], " ").otherwise(""), kind(w), F.when(w["ends_clause"], " ").otherwise(""))), "")
    line = F.regexp_replace(F.replace(line, F.lit("-"), F.lit("")), "a+", "n")
    return F.array_max(F.transform(F.split(line, " +"), F.length))


def last_word(text: Column) -> Column:
    """The last word of Hangul."""
    return F.coalesce(F.get(F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0)), F.size(F.regexp_extract_all(text, F.lit("[가-힣]+"), F.lit(0))) - 1), F.lit(""))


def register_of(text: Column) -> Column:
    """The register of a sentence by its last word of Hangul; null without one."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(REGISTERS):
        out = F.when(last_word(text).rlike(pattern), name).otherwise(out)
    return out


def sentence_key(text: Column) -> Column:
    """One key for sentences that differ in blanks and digits only."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "[0-9]+", "0")


def key_hash(text: Column) -> Column:
    """The first eight bytes of the key's SHA-256, the lowest first, as hex digits."""
    digest = F.sha2(sentence_key(text), 256)
    return F.concat(*[F.substring(digest, 1 + 2 * i, 2) for i in range(7, -1, -1)])


def index_tokens(text: Column) -> Column:
    """Tokens of the index in order: stems, pairs of letters of longer Hangul stems, ASCII words in lower case."""
    stem = lambda w: strip_particle(w["core"])
    pairs = lambda t: F.when(is_hangul(t) & (F.length(t) >= 3), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    ascii_words = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    tokens = lambda t: F.when(is_hangul(t), F.concat(F.array(t), pairs(t))).otherwise(F.concat(ascii_words(t), F.filter(F.regexp_extract_all(t, F.lit("[가-힣]+"), F.lit(0)), lambda x: F.length(x) > 1)))
    return F.flatten(F.transform(words(text), lambda w: tokens(stem(w))))


def query_cores(text: Column) -> Column:
    """Distinct Hangul stems of two letters or more, in order."""
    return F.array_distinct(F.filter(F.transform(words(text), lambda w: strip_particle(w["core"])), lambda t: is_hangul(t) & (F.length(t) >= 2)))


def document_register(sentences: object, least: float = 0.7) -> object:
    """(doc_id, register, share): the most frequent register of a document's sentences, mixed below `least`.

    sentences: doc_id, sentence. Of registers that occur equally often the later one of REGISTERS wins."""
    order = F.array(*[F.lit(name) for name, _ in REGISTERS])
    r = sentences.select("doc_id", register_of(F.col("sentence")).alias("r")).groupBy("doc_id", "r").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("r").isNotNull(), F.struct("n", F.array_position(order, F.col("r")).alias("i"), "r")))
    d = r.groupBy("doc_id").agg(best.alias("b"), F.sum(F.when(F.col("r").isNotNull(), F.col("n"))).alias("total"))
    share = F.coalesce(F.col("b.n") / F.col("total"), F.lit(0.0))
    name = F.when(F.col("b").isNull(), NO_REGISTER).when(share < least, MIXED).otherwise(F.col("b.r"))
    return d.select("doc_id", name.alias("register"), share.alias("share"))
