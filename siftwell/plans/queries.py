"""One registered query per operator. Each takes (spark, folder of tables) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import masks as M
from siftwell.functions import patterns as P
from siftwell.functions import style as S
from siftwell.functions import text as T
from siftwell.operators import bayes, boosting, censor, classwords, clean, dedup, evaluate, features
from siftwell.operators import neighbours, ngrams, sampling, stats, tags, trees
from siftwell.plans import build, train_eval
from siftwell.plans import inputs as I
from siftwell.session import shared_dir
from siftwell.sources import chat, labelled, mailbox, tagged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# sources and sinks


@query
def chat_export_messages(spark: SparkSession, sf: str) -> DataFrame:
    out = chat.messages_from_lines(I.chat_lines(spark, sf))
    stamp = F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at")
    return out.select("path", "msg_no", "sender", stamp, "body")


def _mails(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as mails: base64, quoted-printable and 8-bit bodies in turn, Spanish ones as HTML, and French 8-bit ones
    in Latin-1."""
    subject = F.replace(F.substring("text", 1, 20), F.lit("\n"), F.lit(" "))
    kind = F.when(F.col("lang") == "es", "text/html").otherwise("text/plain")
    turn = F.col("msg_id") % 3
    head = F.concat(
        F.lit("Subject: =?utf-8?b?"), F.base64(F.encode(subject, "utf-8")), F.lit("?=\nMIME-Version: 1.0\nContent-Type: "), kind,
        F.lit("\nContent-Transfer-Encoding: "),
        F.when(turn == 0, "base64").when(turn == 1, "quoted-printable").otherwise("8bit"), F.lit("\n\n"),
    )
    quoted = F.regexp_replace(F.hex(F.encode("text", "utf-8")), "(..)", "=$1")
    latin = F.encode(F.regexp_replace("text", "[^\u0000-\u00ff]", "?"), "iso-8859-1")
    eight = F.when(F.col("lang") == "fr", latin).otherwise(F.encode("text", "utf-8"))
    body = F.when(turn == 0, F.encode(F.base64(F.encode("text", "utf-8")), "utf-8")).when(turn == 1, F.encode(quoted, "utf-8")).otherwise(eight)
    raw = F.concat(F.encode(head, "utf-8"), body)
    return I.documents(spark, sf).select(F.lit("box").alias("path"), F.col("msg_id").alias("msg_no"), raw.alias("raw"))


@query
def mailbox_messages(spark: SparkSession, sf: str) -> DataFrame:
    return mailbox.mail_messages(mailbox.parse_mails(_mails(spark, sf))).select("msg_no", "subject", "body")


@query
def mailbox_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return mailbox.mail_rejects(mailbox.parse_mails(_mails(spark, sf))).select("msg_no", "error")


@query
def labelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("label") == 1, "spam").otherwise("non_spam")
    lines = I.labelled(spark, sf).select(
        "msg_id", F.concat(F.lit("/data/"), "dataset", F.lit("/"), name, F.lit(".txt")).alias("path"),
        F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(" \t")).alias("line"),
    )
    return labelled.label_lines(lines).select("msg_id", "dataset", "label", "text")


@query
def tagged_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tagged.parse_tagged(I.tagged(spark, sf))


@query
def tagged_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return I.tagged(spark, sf).select("msg_id", tagged.plain_from_tagged(F.col("text")).alias("text"))


@query
def sentence_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    marked = I.documents(spark, sf).select("msg_id", M.mask_breaks(F.col("text")).alias("text"))
    return tagged.join_sentences(tagged.cut_sentences(marked))


@query
def text_sink(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/siftwell/{uuid.uuid4().hex}"
    one_line = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    labelled.write_text(I.labelled(spark, sf).withColumn("text", one_line), folder)
    return labelled.read_labelled(spark, folder).select("dataset", "label", "text")


@query
def dataset_build(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chat exports, of two classes, through the whole build."""
    folder = f"{shared_dir(spark)}/siftwell/{uuid.uuid4().hex}"
    found = build.chat_texts(I.chat_lines(spark, sf), "latin")
    label = (F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 2).cast("int").alias("label")
    return build.build_dataset(found.select(F.lit("sms").alias("dataset"), label, "text"), folder).select("dataset", "label", "text")


# cleaning


@query
def chat_header_strip(spark: SparkSession, sf: str) -> DataFrame:
    return I.chat_lines(spark, sf).withColumn("line", clean.strip_header(F.col("line")))


@query
def system_lines(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_system_lines(I.chat_lines(spark, sf, P.SYSTEM_PHRASES[7]))


@query
def blank_line_split(spark: SparkSession, sf: str) -> DataFrame:
    return clean.split_on_blank_line(I.with_blank_lines(I.documents(spark, sf)).select("msg_id", "text"), "text")


@query
def separator_rows(spark: SparkSession, sf: str) -> DataFrame:
    dashes = F.replace(F.col("text"), F.lit(I.DASH_AT), F.lit(f".\n{P.DASH_ROW}\n"))
    text = F.replace(dashes, F.lit(I.PLUS_AT), F.lit(f"\n{P.PLUS_ROW}\nTh"))
    return clean.split_on_separator_rows(I.documents(spark, sf).select("msg_id", text.alias("text")))


@query
def blank_line_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_blank_lines(I.documents(spark, sf)).select("msg_id", T.squeeze_blank_lines(F.col("text")).alias("text"))


@query
def script_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean.keep_script(I.documents(spark, sf), script="accented").select("msg_id", "dataset")


@query
def tagger_rejects(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("lang") == "de", " ul\n").otherwise(F.col("text"))
    return clean.rejected_counts(I.documents(spark, sf).withColumn("text", text))


@query
def script_gate(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["n_words", "n_digits"]
    styled = S.add_style(I.documents(spark, sf).select("msg_id", "text"), script="latin")
    return S.gate_by_script(styled, cols, script="accented").select("msg_id", *cols)


@query
def class_caps(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cap_per_class(I.labelled(spark, sf), {1: 2, 0: 10}).select("msg_id", "dataset", "label")


@query
def dataset_prune(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.prune_datasets(I.labelled(spark, sf)).select("msg_id", "dataset", "label")


@query
def punctuation_pad(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", T.pad_punctuation(F.col("text")).alias("text"))


@query
def blank_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", T.squeeze_blanks(T.pad_punctuation(F.col("text"))).alias("text"))


# joins, duplicates, sampling


@query
def annotation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    labels = I.table(spark, sf, "labels").withColumnRenamed("doc_id", "msg_id")
    out = features.annotate(I.documents(spark, sf), labels)
    return out.select("msg_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query
def dataset_union(spark: SparkSession, sf: str) -> DataFrame:
    one = I.documents(spark, sf).withColumn("label", (F.col("lang") != "en").cast("int"))
    two = I.turns(spark, sf).withColumn("label", (F.col("role") == "system").cast("int"))
    two = two.withColumn("msg_id", F.col("msg_id") + 1_000_000_000)
    return dedup.union_datasets(one, two)


@query
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup(I.documents(spark, sf), ["text"])


@query
def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_counts(I.documents(spark, sf), ["text"])


@query
def dedup_after_censor(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup(censor.censor(I.labelled(spark, sf)), ["dataset", "label", "text"])


@query
def distinct_messages(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.distinct_messages(I.documents(spark, sf))


@query
def class_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.class_conflicts(I.documents(spark, sf).withColumn("label", F.length("dataset") % 2))


@query
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffle_rows(I.documents(spark, sf)).select("msg_id", "shuffle_key")


@query
def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(I.labelled(spark, sf), 0.25).select("msg_id", "label", "is_test")


@query
def k_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.add_folds(I.documents(spark, sf), 5).select("msg_id", "fold")


# censoring


@query
def link_mask(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("html", F.lit(" go "), "url", F.lit(" x:"), "url", F.lit(" a@b.co.il shop.co.il, end"))
    return I.table(spark, sf, "pages").select("page_id", M.mask_links(text).alias("text"))


@query
def phone_mask(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_phone_and_link(I.documents(spark, sf)).select("msg_id", M.mask_phones(F.col("text")).alias("text"))


@query
def email_mask(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", M.mask_emails(F.col("text")).alias("text"))


NAMES, POOL, AND = ["the", "ist", "la", "Of", "des"], ["Alpha", "Beta", "Gamma"], "un"


@query
def name_mask(spark: SparkSession, sf: str) -> DataFrame:
    def letters(w):  # noqa: ANN001, ANN202
        return F.regexp_replace(w, "[^A-Za-z]+", "")

    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return censor.mask_listed_names(I.documents(spark, sf).select("msg_id", "text"), names, POOL, core=letters, prefix=AND)


@query
def glyph_mask(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", M.mask_emoji(F.col("text"), P.SYMBOL_GLYPHS).alias("text"))


@query
def break_markers(spark: SparkSession, sf: str) -> DataFrame:
    body = M.mask_breaks(F.col("text"))
    return I.documents(spark, sf).select("msg_id", M.with_subject(F.col("dataset"), body).alias("text"))


def _censored(spark: SparkSession, sf: str) -> DataFrame:
    return censor.censor(I.with_phone_and_link(I.documents(spark, sf)), glyphs=P.SYMBOL_GLYPHS)


@query
def censor_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _censored(spark, sf).select("msg_id", "text")


@query
def marker_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return censor.extract_variables(_censored(spark, sf))


@query
def glyph_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return censor.glyph_inventory(I.documents(spark, sf), glyphs=P.SYMBOL_GLYPHS)


# scalar functions


@query
def script_letters(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", T.script_only(F.col("text"), "latin").alias("text"))


@query
def sign_letters(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("msg_id", T.signs(F.col("text")).alias("signs"))


@query
def ascii_rest(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return I.documents(spark, sf).select("msg_id", T.is_ascii(t).cast("int").alias("is_ascii"), T.non_ascii(t).alias("rest"))


@query
def mean_of_positive(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"\|"))
    out = stats.mean_positive_by(I.documents(spark, sf), n, "dataset")
    return out.withColumn("mean_positive", F.round("mean_positive", 6))


@query
def ranked_words(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the 50 most frequent words."""
    words = I.documents(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word"))
    return stats.ranked(words.groupBy("word").agg(F.count("*").alias("n")), "word", top=50)


# n-grams, vocabularies, class words


@query
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.ngram_counts(ngrams.explode_ngrams(_censored(spark, sf), kinds=["word"]))


@query
def letter_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.ngram_counts(ngrams.explode_ngrams(I.documents(spark, sf), kinds=["letter"]))


@query
def tag_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return tags.ngram_counts(tags.tag_ngrams_of_tokens(I.conversation_tokens(spark, sf)))


@query
def tag_ngrams_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return tags.ngram_counts(tags.tag_ngrams(tagged.tag_sentences(I.tagged(spark, sf))))


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.add_folds(I.labelled(spark, sf), 5)


def _train_vocabulary(spark: SparkSession, sf: str, kinds: list[str]) -> DataFrame:
    train = _folded(spark, sf).where("fold <> 0")
    return ngrams.fit_vocabulary(ngrams.explode_ngrams(train, kinds=kinds))


@query
def train_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _train_vocabulary(spark, sf, ["word", "letter"])


@query
def fold_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabularies of all folds as one table."""
    grams = ngrams.explode_ngrams(_folded(spark, sf), keep=["msg_id", "fold"])
    return ngrams.fold_vocabulary(grams)


def _train_terms(spark: SparkSession, sf: str, kinds: list[str]) -> DataFrame:
    train = _folded(spark, sf).where("fold <> 0")
    return ngrams.fold_vocabulary(ngrams.explode_ngrams(train, kinds=kinds, keep=["msg_id", "fold"]))


@query
def token_presence(spark: SparkSession, sf: str) -> DataFrame:
    test = _folded(spark, sf).where("fold = 0")
    grams = ngrams.explode_ngrams(test, kinds=["word", "letter"], distinct=True)
    return ngrams.match_terms(grams, _train_terms(spark, sf, ["word", "letter"])).drop("folds")


@query
def token_presence_all_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Every message against the vocabulary of the other folds, in one plan."""
    grams = ngrams.explode_ngrams(_folded(spark, sf), keep=["msg_id", "fold"], distinct=True)
    found = ngrams.match_terms(grams, ngrams.fold_vocabulary(grams), ["msg_id", "fold"])
    return found.where(ngrams.known_to_others(F.col("folds"), F.col("fold"))).drop("folds", "fold")


@query
def substring_presence(spark: SparkSession, sf: str) -> DataFrame:
    test = _folded(spark, sf).where("fold = 0")
    return ngrams.match_substrings(test, _train_terms(spark, sf, ["word"])).drop("folds", "kind")


@query
def substring_presence_all_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Every message against the vocabulary of the other folds, in one plan."""
    folded = _folded(spark, sf)
    grams = ngrams.explode_ngrams(folded, kinds=["word"], keep=["msg_id", "fold"])
    found = ngrams.match_substrings(folded, ngrams.fold_vocabulary(grams), id_cols=["msg_id", "fold"])
    return found.where(ngrams.known_to_others(F.col("folds"), F.col("fold"))).select("msg_id", "term", "value")


@query
def class_words(spark: SparkSession, sf: str) -> DataFrame:
    return classwords.class_words(_flat(I.labelled(spark, sf)), script="latin")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))


@query
def class_word_hits(spark: SparkSession, sf: str) -> DataFrame:
    folded = _flat(_folded(spark, sf))
    bag = classwords.class_words(folded.where("fold <> 0"), script="latin")
    return classwords.class_word_hits(folded, bag, script="latin")


@query
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tags.tag_counts(I.conversation_tokens(spark, sf))


@query
def tag_count_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tags.tag_count_columns(I.conversation_tokens(spark, sf), ["user", "assistant", "system"])


@query
def tag_ngram_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return tags.ngram_sentences(tags.tag_ngrams_of_tokens(tagged.parse_tagged(I.tagged(spark, sf))))


# trees


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return trees.reachable_nodes(I.conversation_tokens(spark, sf))


@query
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).select("msg_id", "tok_no", "head", "level")


@query
def tree_depths(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_depths(_nodes(spark, sf))


@query
def tree_most_children(spark: SparkSession, sf: str) -> DataFrame:
    return trees.most_children(_nodes(spark, sf))


@query
def tree_relations(spark: SparkSession, sf: str) -> DataFrame:
    return trees.relation_kinds(_nodes(spark, sf))


@query
def tree_shape_of_tagged_text(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_shape(trees.reachable_nodes(tagged.parse_tagged(I.tagged(spark, sf), unit="tree")))


@query
def tree_path_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return trees.path_ngram_counts(trees.path_ngrams(_nodes(spark, sf)))


@query
def tree_path_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return trees.path_vocabulary(trees.path_ngrams(_nodes(spark, sf)))


# statistics and style


@query
def class_statistics(spark: SparkSession, sf: str) -> DataFrame:
    text = censor.censor(I.with_phone_and_link(I.labelled(spark, sf)), glyphs=P.SYMBOL_GLYPHS)
    out = stats.class_statistics(stats.message_counts(text))
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns if c != "label"])


@query
def class_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_glyphs(censor.censor(I.labelled(spark, sf), glyphs=P.SYMBOL_GLYPHS))


def _style(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    out = S.add_style(_censored(spark, sf), script="latin")
    rounded = [F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c).cast("bigint").alias(c) for c in columns]
    return out.select("msg_id", *rounded)


@query
def style_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_words", "n_letters", "longest_word")


@query
def style_links(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_links", "link_length", "link_place")


@query
def style_phones(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "phone_1", "phone_2", "phone_3", "phone_4", "phone_5", "phone_at")


@query
def style_signs(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_signs", "sign_share", "n_punctuation")


@query
def style_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_emoji", "emoji_share")


@query
def style_script(spark: SparkSession, sf: str) -> DataFrame:
    out = S.add_style(_censored(spark, sf), script="accented")
    return out.select("msg_id", *[F.round(c, 6).alias(c) for c in ("script_share", "script_ratio")])


@query
def style_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_sentences")


@query
def style_digits(spark: SparkSession, sf: str) -> DataFrame:
    return _style(spark, sf, "n_digits", "digit_share")


# assembly


@query
def feature_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as messages: words, class words, tags, trees and style in one long table."""
    text = I.turns(spark, sf).select("msg_id", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text"), "role")
    grams = ngrams.explode_ngrams(text, kinds=["word"], sizes=[1], distinct=True)
    bag = classwords.class_words(text.withColumn("label", (F.col("role") == "user").cast("int")), script="latin")
    notes = I.tagged(spark, sf)
    out = features.long_features(
        text, ngrams.match_terms(grams, ngrams.fit_vocabulary(grams)), bag, tagged.parse_tagged(notes),
        tagged.parse_tagged(notes, unit="tree"), True, True, script="latin",
    )
    return out.withColumn("value", F.round("value", 6))


@query
def sparse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Size and sums of the index and value arrays that go into a model."""
    grams = ngrams.explode_ngrams(I.labelled(spark, sf), kinds=["word"], sizes=[1], distinct=True)
    vocab = ngrams.fit_vocabulary(grams)
    rows = features.sparse_rows(grams.withColumn("value", F.lit(1.0)), vocab.drop("value"))
    return rows.select(
        "msg_id", F.size("idx").alias("n_slots"), F.aggregate("idx", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("idx_sum"),
        F.array_min("idx").alias("first_idx"), F.array_max("idx").alias("last_idx"),
    )


# classifiers


@query
def naive_bayes_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = train_eval.bayes_predictions(censor.censor(I.labelled(spark, sf)))
    return out.select(
        "msg_id", "fold", "label", "predicted", F.round("score0", 3).alias("score0"), F.round("score1", 3).alias("score1")
    )


@query
def naive_bayes_holdout(spark: SparkSession, sf: str) -> DataFrame:
    out = train_eval.bayes_predictions(I.labelled(spark, sf), k=1)
    return out.select("msg_id", "label", "predicted", F.round("score0", 3).alias("score0"), F.round("score1", 3).alias("score1"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"),
        T.fold_of(F.col("vec_id"), 5).alias("fold"),
    )


def _nearest(spark: SparkSession, sf: str, fold: int | None = None) -> DataFrame:
    """One fold against the other four, or every row against the rows of the other folds."""
    v = _vectors(spark, sf)
    return neighbours.nearest(v, v if fold is None else v.where(F.col("fold") == fold), apart="fold")


@query
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 0).select("test_id", "train_id", "rank")


@query
def nearest_neighbours_all_folds(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select("test_id", "train_id", "rank")


@query
def nearest_neighbour_votes(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.vote(_nearest(spark, sf, 0))


@query
def nearest_neighbour_votes_all_folds(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.vote(_nearest(spark, sf))


def _word_rows(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(ngrams.word_ngrams(ngrams.normalise_markers(F.col("text")), 1))
    return I.labelled(spark, sf).select("msg_id", "label", words.alias("terms"))


@query
def boosting_stump_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _word_rows(spark, sf).withColumn("w", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    return boosting.stump_errors(rows).withColumn("error", F.round("error", 6))


def _numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Words and all style numbers of the labelled messages."""
    styled = S.add_style(_flat(I.labelled(spark, sf)), script="latin")
    numbers = F.array(*[F.struct(F.lit(f"style:{c}").alias("term"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in S.STYLE_COLUMNS])
    return _word_rows(spark, sf).join(styled.select("msg_id", numbers.alias("numbers")), "msg_id")


@query
def boosting_cut_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every threshold of every style number, with weights."""
    rows = _numbered_rows(spark, sf).withColumn("w", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    return boosting.cut_errors(rows).select("term", F.round("cut", 9).alias("cut"), "present", F.round("error", 6).alias("error"))


@query
def boosting_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered_rows(spark, sf)
    return boosting.predict(boosting.fit(rows), rows).withColumn("margin", F.round("margin", 6))


ONE_WORD = {"sizes": [1], "kinds": ["word"]}  # iterative models take minutes on all n-gram sizes even of small tables


def _model(spark: SparkSession, sf: str, name: str, **options: object) -> DataFrame:
    """Five folds on all n-gram sizes, with the library's own settings but for options."""
    out, _ = train_eval.model_predictions(_flat(I.labelled(spark, sf)), 5, [name], script="latin", **options)
    return out


@query
def model_naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "MultinomialNB")


@query
def naive_bayes_full_features(spark: SparkSession, sf: str) -> DataFrame:
    """The one-pass form on the features of model_naive_bayes: the same rows, by the same SQL."""
    out = train_eval.full_bayes_predictions(_flat(I.labelled(spark, sf)), script="latin")
    return out.select("msg_id", "model", "fold", "label", "predicted")


@query
def model_logistic_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "LogisticRegression", **ONE_WORD)


@query
def model_k_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "KNeighbors")


@query
def model_linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "SVM", **ONE_WORD)


@query
def model_ada_boost(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "AdaBoost", rounds=10, **ONE_WORD)  # boosting_predictions has all 50


@query
def model_set(spark: SparkSession, sf: str) -> DataFrame:
    """All five models on one hold-out, with their times."""
    return train_eval.model_set(_flat(I.labelled(spark, sf)), script="latin", rounds=10, **ONE_WORD)


# evaluation


@query
def baseline_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.baseline_accuracy(I.labelled(spark, sf))
    return out.withColumn("baseline", F.round("baseline", 6))


@query
def accuracy_margin(spark: SparkSession, sf: str) -> DataFrame:
    base = evaluate.baseline_accuracy(I.labelled(spark, sf)).first()["baseline"]
    out = evaluate.accuracy(I.rule_predictions(spark, sf), F.lit(base))
    return out.select("model", "fold", F.round("accuracy", 6).alias("accuracy"), F.round("margin", 6).alias("margin"))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(I.rule_predictions(spark, sf))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def f1_paper(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.f1_scores(evaluate.confusion(I.rule_predictions(spark, sf)))
    return _rounded(out, "recall", "precision", "f1")


@query
def f1_as_written(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.f1_scores(evaluate.confusion(I.rule_predictions(spark, sf)), "as_written")
    return _rounded(out, "recall", "precision", "f1")


@query
def weighted_scores_paper(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.weighted_scores(evaluate.confusion(I.rule_predictions(spark, sf))), "wacc", "tcr")


@query
def weighted_scores_as_written(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.confusion(I.rule_predictions(spark, sf))
    return _rounded(evaluate.weighted_scores(m, convention="as_written"), "wacc", "tcr")


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.class_report(I.rule_predictions(spark, sf)), "precision", "recall", "f1")


@query
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fold_summary(evaluate.fold_scores(I.rule_predictions(spark, sf)))


@query
def summary_by_lambda(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary_by_lambda(evaluate.fold_scores(I.rule_predictions(spark, sf)))


@query
def folds_above_one(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.folds_above_one(evaluate.fold_scores(I.rule_predictions(spark, sf)))


@query
def error_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_report(I.rule_predictions(spark, sf))


@query
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """All that a run of naive Bayes over five folds is judged by."""
    censored = censor.censor(I.labelled(spark, sf))
    out = train_eval.run_report(censored, train_eval.bayes_predictions(censored))
    return out.withColumn("value", F.round("value", 4))


@query
def spam_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: raw labelled messages to the fold summary of naive Bayes."""
    return train_eval.spam_scores(I.labelled(spark, sf))


@query
def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    halves = F.when(F.length("dataset") % 2 == 0, "sms").otherwise("email")
    runs = [train_eval.Run(non_spam_cap=None), train_eval.Run(non_spam_cap=100), train_eval.Run(k=1, union=True)]
    out = train_eval.run_grid(_flat(I.labelled(spark, sf)).withColumn("dataset", halves), runs, script="latin")
    return out.drop("plan_seconds").na.fill(-1, ["spam_cap", "non_spam_cap"])


def _tagged_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as tagged messages of one dataset; long answers play the second class."""
    rows = I.tagged(spark, sf).withColumn("dataset", F.lit("turns"))
    return rows.withColumn("label", (F.size(T.words(F.col("text"))) > 100).cast("int"))


@query
def annotation_terms(spark: SparkSession, sf: str) -> DataFrame:
    out = features.annotation_features(I.tagged(spark, sf))
    one = F.inline("counted")
    return out.select("msg_id", "depth", "most_children", "n_relations", one)


@query
def experiment_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """A morphological run with tag and tree features."""
    runs = [train_eval.Run(model=1, k=1, morphological=True, tags=True, trees=True)]
    out = train_eval.run_grid(_tagged_turns(spark, sf), runs, script="latin", sizes=[1], kinds=["word"])
    return out.drop("plan_seconds").na.fill(-1, ["spam_cap", "non_spam_cap"])


