"""Feature blocks and their assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.style import STYLE_COLUMNS, add_style
from siftwell.functions.text import has_script
from siftwell.operators.classwords import class_word_hits, fold_class_word_hits, fold_class_words
from siftwell.operators.ngrams import letter_ngrams, normalise_markers, word_ngrams
from siftwell.operators.tags import ngram_sentences, tag_counts, tag_ngrams_of_tokens
from siftwell.operators.skew import hot_join
from siftwell.operators.trees import path_ngram_counts, path_ngrams, reachable_nodes, tree_shape
from siftwell.session import cut_lineage
from siftwell.sources.tagged import parse_tagged

SCALARS = [*STYLE_COLUMNS, "non_spam_words", "spam_words"]
TREE_SCALARS = ["depth", "most_children", "n_relations"]
MAX_WIDTH = 1 << 26  # terms of a vocabulary; a linear model keeps its weights on the driver, so more than that fails
SLOTS_AT_ONCE = 1 << 21  # slots of linear models that are fitted beside each other: the driver holds some 26 numbers a slot


def annotate(messages: DataFrame, annotations: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Messages with their annotation, if there is one."""
    return messages.join(annotations, id_col, "left")


def unpivot_scalars(df: DataFrame, columns: Sequence[str], kind: str, id_cols: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Wide scalar columns to (msg_id, kind, term, value). Narrow."""
    pairs = [F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*id_cols, F.lit(kind).alias("kind"), F.inline(F.array(*pairs)))


def long_features(
    messages: DataFrame,
    vocab_hits: DataFrame | None = None,
    bag: DataFrame | None = None,
    tokens: DataFrame | None = None,
    tree_tokens: DataFrame | None = None,
    with_tags: bool = False,
    with_trees: bool = False,
    text: str = "text",
    script: str = "hebrew",
    id_col: str = "msg_id",
    gate: bool = True,
) -> DataFrame:
    """features(msg_id, kind, term, value): n-gram, class word, tag, tree and style blocks. Zeros are left out. With
    gate a message without a letter of the script has no row, which is its zero vector. messages may be one of several
    folds; vocab_hits and bag are made from training rows. Tags are taken from tokens by sentence, trees from
    tree_tokens by tree (parse_tagged with that unit)."""
    style = add_style(messages.select(id_col, text), text, script)
    blocks = [unpivot_scalars(style, STYLE_COLUMNS, "style", [id_col])]
    if vocab_hits is not None:
        blocks.append(vocab_hits.select(id_col, "kind", "term", "value"))
    if bag is not None:
        hits = class_word_hits(messages, bag, text, script, id_col)
        blocks.append(unpivot_scalars(hits, ["non_spam_words", "spam_words"], "class_words", [id_col]))

    def numbered(df: DataFrame, kind: str, term: str, value: str) -> DataFrame:
        return df.select(id_col, F.lit(kind).alias("kind"), F.col(term).alias("term"), F.col(value).cast("double").alias("value"))

    if with_tags:
        blocks.append(numbered(tag_counts(tokens, id_col), "tag", "pos", "n"))
        blocks.append(numbered(ngram_sentences(tag_ngrams_of_tokens(tokens), id_col), "tag_ngram", "term", "n"))
    if with_trees:
        nodes = reachable_nodes(tree_tokens)
        shape = tree_shape(nodes, id_col=id_col)
        blocks.append(unpivot_scalars(shape, TREE_SCALARS, "tree", [id_col]))
        blocks.append(numbered(path_ngram_counts(path_ngrams(nodes), id_col), "tree_ngram", "term", "n"))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    out = out.where(F.col("value") != 0)
    if gate:
        out = out.join(messages.where(has_script(F.col(text), script)).select(id_col), id_col, "left_semi")
    return out


def sparse_rows(features: DataFrame, vocab: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(msg_id, idx array, val array), sorted by idx: one row per message, values joined to the dense index of
    vocab(kind, term, n, idx)."""
    placed = hot_join(features, vocab, ["kind", "term"], "n", [id_col])
    pairs = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_p"))
    return pairs.select(id_col, F.col("_p.idx").alias("idx"), F.col("_p.value").alias("val"))


def term_array(
    text: str = "text", sizes: Sequence[int] = (1, 2, 3), kinds: Sequence[str] = ("word", "letter")
) -> Column:
    """Distinct n-grams of a message as "kind:term" strings, in the row."""
    joined = normalise_markers(F.col(text))
    make = {"word": lambda n: word_ngrams(joined, n), "letter": lambda n: letter_ngrams(F.col(text), n)}
    grams = {k: F.concat(*[make[k](n) for n in sizes]) for k in kinds}

    def prefixed(kind: str) -> Column:
        return F.transform(F.array_distinct(grams[kind]), lambda t: F.concat(F.lit(f"{kind}:"), t))

    return F.concat(*[prefixed(k) for k in kinds])


def annotation_features(tagged_messages: DataFrame, with_tags: bool = True, with_trees: bool = True) -> DataFrame:
    """(msg_id, counted, depth, most_children, n_relations) of tagged text: counted is an array of (term, n) for tags,
    tag n-grams and tree paths; the scalars are those of the trees. One row per message that has any."""
    parts = []
    if with_tags:
        tokens = cut_lineage(parse_tagged(tagged_messages).select("msg_id", "sent_no", "tok_no", "pos"))  # counted twice
        parts.append(tag_counts(tokens).select("msg_id", F.concat(F.lit("tag:"), "pos").alias("term"), "n"))
        grams = ngram_sentences(tag_ngrams_of_tokens(tokens))
        parts.append(grams.select("msg_id", F.concat(F.lit("tag_ngram:"), "term").alias("term"), "n"))
    shape = tagged_messages.select("msg_id", *[F.lit(0).alias(c) for c in TREE_SCALARS])
    if with_trees:
        nodes = reachable_nodes(parse_tagged(tagged_messages, unit="tree"))
        paths = path_ngram_counts(path_ngrams(nodes))
        parts.append(paths.select("msg_id", F.concat(F.lit("tree_ngram:"), "term").alias("term"), "n"))
        shape = tree_shape(nodes)
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    lists = counts.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("counted"))
    return cut_lineage(lists.join(shape, "msg_id", "left").select("msg_id", "counted", *TREE_SCALARS))


class Vectoriser:
    """Messages to sparse MLlib vectors: n-gram presence, class word hits, style, and on request tag and tree counts,
    without a shuffle of the n-grams.

    The vocabulary is that of the training rows. It has to fit the driver, as the weights of a linear model do: more
    than max_width terms are an error, no terms share a slot and none is dropped. Without vectors there is neither
    vocabulary nor vector, only what a vector is made of, which is all that models without weights on the driver need."""

    def __init__(
        self, sizes: Sequence[int] = (1, 2, 3), kinds: Sequence[str] = ("word", "letter"), script: str = "hebrew",
        max_width: int = MAX_WIDTH, style: bool = True, annotated: bool = False, vectors: bool = True,
    ) -> None:
        self.sizes, self.kinds, self.script, self.max_width, self.style = sizes, kinds, script, max_width, style
        self.annotated = annotated  # messages bring the columns of annotation_features
        self.vectors = vectors

    def fit(self, train: DataFrame, bag: DataFrame) -> Vectoriser:
        self.counters = []
        if self.vectors:
            self.counters.append(self._counter(train.select(term_array("text", self.sizes, self.kinds).alias("_terms")), True))
        if self.vectors and self.annotated:
            self.counters.append(self._counter(train.select(_repeated().alias("_tags")), False))
        self.bag = bag
        return self

    def _counter(self, rows: DataFrame, binary: bool) -> tuple[CountVectorizerModel, int]:
        name = rows.columns[0]
        made = {"binary": binary, "inputCol": name, "outputCol": f"{name}_v"}
        counter = CountVectorizer(vocabSize=self.max_width + 1, minDF=1.0, **made).fit(rows)
        empty = rows.sparkSession.createDataFrame([([],)], f"{name} array<string>")
        width = counter.transform(empty).select(F.col(f"{name}_v").alias("v", metadata={})).first().v.size
        if width > self.max_width:
            raise ValueError(f"the vocabulary has more than max_width={self.max_width} terms")
        return counter, width

    def columns(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """df with what a message has by itself, whatever rows are trained on: _terms, counted, _tags, style and trees;
        and the names of all scalars in order, class word hits included, which are not made here."""
        ok = has_script(F.col("text"), self.script)
        rows = df.withColumn("_ok", ok).withColumn("text", F.when(ok, F.col("text")).otherwise(""))
        rows = rows.withColumn("_terms", term_array("text", self.sizes, self.kinds))
        scalars: list[str] = []
        if self.style:
            # an empty message still counts as one sentence
            rows = add_style(rows, script=self.script).withColumn("n_sentences", F.when(F.col("text") != "", F.col("n_sentences")).otherwise(0))
            scalars = SCALARS
        none = F.array().cast("array<struct<term: string, n: bigint>>")
        rows = rows.withColumn("counted", F.when(F.col("_ok") & F.col("counted").isNotNull(), F.col("counted")).otherwise(none) if self.annotated else none)
        if self.annotated:
            rows = rows.withColumns({c: F.when(F.col("_ok"), F.coalesce(c, F.lit(0))).otherwise(0) for c in TREE_SCALARS})
            rows, scalars = rows.withColumn("_tags", _repeated()), [*scalars, *TREE_SCALARS]
        return rows, scalars

    def transform(self, df: DataFrame, keep: Sequence[str] = ("msg_id", "label", "fold")) -> DataFrame:
        """keep columns + features (vector), and what it is made of: terms (array of "kind:term"), counted (array of
        term and n) and scalars (array in the order of SCALARS). A message without a letter of the script is a zero
        vector."""
        rows, scalars = self.columns(df)
        if self.style:
            ok = has_script(F.col("text"), self.script)
            own = df.withColumn("text", F.when(ok, F.col("text")).otherwise(""))
            rows = rows.join(class_word_hits(own, self.bag, script=self.script), "msg_id")
        blocks = []
        for counter, width in self.counters:
            rows = counter.transform(rows)
            # the names of all slots would travel with the schema: keep only their number, and not even that afterwards
            name = counter.getOutputCol()
            rows = rows.withColumn(name, F.col(name).alias(name, metadata=_sized(width)))
            blocks.append(name)
        kept = [c for c in keep if c in df.columns]
        values = F.array(*[F.col(c).cast("double") for c in scalars]).cast("array<double>")
        made = [F.col("_terms").alias("terms"), F.col("counted"), values.alias("scalars")]
        if not self.vectors:
            return rows.select(*kept, *made)
        out = VectorAssembler(inputCols=blocks + scalars, outputCol="features").transform(rows)
        return out.select(*kept, F.col("features").alias("features", metadata={}), *made)


class FoldVectors:
    """What Vectoriser gives for every one of the folds, made once for all of them: terms, style and annotations are the
    same in each, class words are counted in one pass, and one vocabulary of all rows (see Vectoriser) numbers the slots.

    A slot without a training row has a weight of zero in a linear model, as a term that is not in the vocabulary has, so
    the models are those of one vocabulary per fold."""

    def __init__(
        self, folded: DataFrame, folds: Sequence[int], sizes: Sequence[int] = (1, 2, 3), kinds: Sequence[str] = ("word", "letter"),
        script: str = "hebrew", max_width: int = MAX_WIDTH, annotated: bool = False, vectors: bool = True,
    ) -> None:
        made = Vectoriser(sizes, kinds, script, max_width, annotated=annotated)
        own_rows, self.scalars = made.columns(folded)
        hits = fold_class_word_hits(folded.where(has_script(F.col("text"), script)), fold_class_words(folded, folds, script=script), script=script)
        words = ("non_spam_words", "spam_words")
        # rows of one id on the same side of a fold have their hits in common
        sides = hits.groupBy("msg_id", "asked", (F.col("fold") == F.col("asked")).alias("tested")).agg(*[F.sum(c).alias(c) for c in words])
        lists = sides.groupBy("msg_id").agg(F.collect_list(F.struct("asked", "tested", *words)).alias("_hits"))  # two entries a fold at most
        own = [F.col(c).cast("double").alias(c) for c in self.scalars if c not in words]
        kept = own_rows.where("msg_id IS NOT NULL").select("msg_id", "label", "fold", F.col("_terms").alias("terms"), "counted", *own)
        self.rows = cut_lineage(kept.join(lists, "msg_id", "left"))
        self.blocks: list[tuple[str, int]] = []
        if vectors:
            self._add_blocks(made, annotated)

    def _add_blocks(self, made: Vectoriser, annotated: bool) -> None:
        """The blocks of a vector that are the same in every fold, written with the rows."""
        counters = [made._counter(self.rows.select(F.col("terms").alias("_terms")), True)]
        rows = self.rows.withColumn("_terms", F.col("terms"))
        if annotated:
            counters.append(made._counter(self.rows.select(_repeated().alias("_tags")), False))
            rows = rows.withColumn("_tags", _repeated())
        for counter, width in counters:
            name = counter.getOutputCol()
            rows = counter.transform(rows)
            # the names of all slots would travel with the schema
            rows = rows.withColumn(name, F.col(name).alias(name, metadata={}))
            self.blocks.append((name, width))
        self.rows = cut_lineage(rows.drop("_terms", "_tags"))

    def fits_at_once(self) -> int:
        """Linear models that may be fitted beside each other. A fit is a row of short jobs, which leave cores idle."""
        return max(1, SLOTS_AT_ONCE // (sum(width for _, width in self.blocks) + len(self.scalars)))

    def of_fold(self, fold: int) -> DataFrame:
        """(msg_id, label, fold, features with vectors, terms, counted, scalars) of all rows, as the model that is tested on the
        fold sees them: class words are those of the other folds. Narrow. The assembler names every slot in its plan, so
        features should be written before many jobs read them."""
        own = F.filter("_hits", lambda h: (h["asked"] == fold) & (h["tested"] == (F.col("fold") == fold)))
        hits = F.get(own, F.lit(0))
        values = [F.coalesce(hits[c], F.lit(0)).cast("double") if c in ("non_spam_words", "spam_words") else F.col(c) for c in self.scalars]
        kept = ["msg_id", "label", "fold", "terms", "counted"]
        if not self.blocks:
            return self.rows.select(*kept, F.array(*values).alias("scalars"))
        blocks = [F.col(name).alias(name, metadata=_sized(width)) for name, width in self.blocks]
        rows = self.rows.select(*kept, *blocks, F.array(*values).alias("scalars")).withColumn("_numbers", array_to_vector("scalars"))
        rows = rows.withColumn("_numbers", F.col("_numbers").alias("_numbers", metadata=_sized(len(values))))
        out = VectorAssembler(inputCols=[*(name for name, _ in self.blocks), "_numbers"], outputCol="features").transform(rows)
        return out.select(*kept[:3], F.col("features").alias("features", metadata={}), "terms", "counted", "scalars")


def _sized(n: int) -> dict:
    return {"ml_attr": {"num_attrs": n}}


def _repeated() -> Column:
    """Every counted term n times, as MLlib counts them."""
    return F.flatten(F.transform(F.coalesce("counted", F.array()), lambda c: F.array_repeat(c["term"], c["n"].cast("int"))))
