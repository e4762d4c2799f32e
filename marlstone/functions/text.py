"""Normalisation, tokens, n-grams and the texts that encoders read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Stop words that are dropped from queries and items.
STOP_WORDS = (
    "и в во на по с со к ко у о об от до за из для при про без над под через а но или ли же бы не ни то это как что "
    "так уже все всё вы мы я он она они его ее её их мой ваш наш свой"
).split()

# Phrases that say nothing in a filter text (prices, working hours, orders, experience).
PHRASES = (
    "Начальная цена",
    r"Тип стоимости за (услугу|час|урок|день|м²|м2|км|смену|ед\.?)",
    r"Стоимость \d+",
    r"График работы(, дни недели)? (от|до)?\s*\S+",
    r"Время работы, (с|до) \S+",
    "Дни (пн|вт|ср|чт|пт|сб|вс)",
    r"Рабочие дни \S+",
    "Продолжительность [^А-Я]*",
    r"Признак предзаполнения прайс листа \d+",
    "Услуга Своя услуга",
    r"Минимальная сумма заказа \d+",
    r"Выполняю заказы от \d+",
    "Опыт работы [^А-Я]*",
)
BOILERPLATE = "(" + "|".join(PHRASES) + ")"


def normalize(col: Column | str) -> Column:
    """Lower case, yo as ye, every run outside Latin and Russian letters and digits one space, trimmed; null: ''.

    In lower case ``\\p{Alnum}`` is a-z and 0-9. A class with two ranges is not used: Java takes seven times as long over three.
    """
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    # Java writes the small form of this one letter as two characters, SQL as i.
    low = F.replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(low, r"[^\p{Alnum}а-я]+", " "))


def tokens(df: DataFrame, id_col: str, text_col: str, max_tokens: int | None = None) -> DataFrame:
    """(id, pos, token): the first ``max_tokens`` tokens of the normalised text, stop words counting, then no empty ones."""
    words = F.split(normalize(text_col), " ")
    words = words if max_tokens is None else F.slice(words, 1, max_tokens)
    return df.select(id_col, F.posexplode(words).alias("pos", "token")).where("token <> ''")


def all_tokens(text_col: str) -> Column:
    """The tokens that :func:`tokens` gives of a whole text, as an array in order; their positions are their places in it."""
    return F.filter(F.split(normalize(text_col), " "), lambda w: w != "")


def drop_stop(tok: DataFrame) -> DataFrame:
    return tok.where(~F.col("token").isin(STOP_WORDS))


def kept_tokens(text_col: str, max_tokens: int | None = None) -> Column:
    """The tokens that :func:`tokens` and :func:`drop_stop` leave of a text, as an array in order."""
    words = F.split(normalize(text_col), " ")
    words = words if max_tokens is None else F.slice(words, 1, max_tokens)
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def bigrams(tok: DataFrame, id_cols: list[str], term: str = "term") -> DataFrame:
    """Pairs of terms that follow each other once dropped words are gone, so that they bridge gaps."""
    nxt = F.lead(term).over(Window.partitionBy(*id_cols).orderBy("pos"))
    return tok.withColumn("next", nxt).where("next is not null").select(*id_cols, "pos", F.concat(term, F.lit("§"), "next").alias(term))


def following(words: Column) -> Column:
    """The pairs (first, second) of words that follow each other in an array."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.struct(a.alias("first"), b.alias("second")))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(words: Column) -> Column:
    """The distinct words of an array with their numbers: where runs of the sorted words start, and how far apart."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("term"), i.alias("i"))), lambda r: (r["i"] == 0) | (r["term"] != F.get(s, r["i"] - 1)))
        return once(first, lambda at: F.transform(at, lambda r, k: F.struct(r["term"].alias("term"), (F.coalesce(F.get(at, k + 1)["i"], F.size(s)) - r["i"]).cast("long").alias("tf"))))

    return once(F.sort_array(words), runs)


def term_counts(rows: DataFrame, terms: str, tasks: int) -> DataFrame:
    """(term, n): how often each term stands in the arrays of ``terms``, counted by so many tasks.

    Terms are counted inside their row first, so that one task gets a frequent term once per row; they are not
    counted again before the shuffle, where most differ and their table would grow with the rows of a task.
    """
    seen = rows.select(F.explode(counted(F.col(terms))).alias("o")).select("o.term", "o.tf")
    return seen.repartition(tasks, "term").groupBy("term").agg(F.sum("tf").alias("n"))


def clean_params(col: Column | str, max_chars: int = 400, pattern: str = BOILERPLATE) -> Column:
    """Filter text without boilerplate, white space collapsed, trimmed, cut to ``max_chars`` characters."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, pattern, " "), r"\s+", " ")), 1, max_chars)


def item_text(title: str, params: str, description: str) -> Column:
    """The passage of an item: title, cleaned filter text, start of the description."""
    text = F.substring(F.regexp_replace(F.coalesce(F.col(description), F.lit("")), r"\s+", " "), 1, 600)
    return F.concat(F.lit("passage: "), F.coalesce(F.col(title), F.lit("")), F.lit(". "), clean_params(params, 250), F.lit(". "), text)


def query_text(query: str, filters: str | None = None) -> Column:
    """The query as an encoder reads it, with its trimmed filter text if there is any."""
    head = F.concat(F.lit("query: "), F.coalesce(F.col(query), F.lit("")))
    if filters is None:
        return head
    extra = F.trim(F.coalesce(F.col(filters), F.lit("")))
    return F.when(extra != "", F.concat(head, F.lit(" | "), extra)).otherwise(head)


def text_length(col: str) -> Column:
    return F.char_length(F.coalesce(F.col(col), F.lit("")))


def char_ngrams(col: Column | str, least: int = 3, most: int = 4) -> Column:
    """All n-grams inside each word of the normalised text, the word padded with a blank on both sides.

    A padded word no longer than n gives itself once and no longer n-grams.
    """

    def cut(padded: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.char_length(padded)
        first = F.when(size >= least, cut(padded, least)).otherwise(F.array(padded))
        none = F.array().cast("array<string>")
        return F.flatten(F.array(first, *[F.when(size >= n, cut(padded, n)).otherwise(none) for n in range(least + 1, most + 1)]))

    words = F.filter(F.split(normalize(col), " "), lambda w: w != "")
    return F.flatten(F.transform(words, grams))
