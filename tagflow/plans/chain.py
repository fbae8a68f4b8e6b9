"""The staged pipeline, wired lazily.

``Pipeline`` names each stage of the tweet chain as a property; a stage is
built on first use and shared by the stages after it, so a query that needs
``nodes`` builds tweets -> data -> data1 -> data2 -> df -> incidence ->
counts -> nodes once.  Stages that several later steps read (data1, df, tag
segments, TF-IDF, weighted edges, label rounds, pooled texts, the LDA
corpus) are written once to the shared checkpoint folder.  Nothing here
collects rows to the driver; the eager steps are those checkpoints and a few
counts of small or checkpointed tables (node and phrase counts, which decide
broadcasts).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import clean, communities, docs, embeddings, enrich, gibbs, graph, ingest, similarity, tags, topics
from ..session import stage
from ..sources import fixtures

# Default parameters of the registered queries.
MIN_WORDS = 3          # preprocess(min_word)
POPULAR_MIN = 3        # hashtag_explore(n)
TAG_MODE = "text_h_in"
TFIDF_MAX_DF = 0.5     # hashdocs_tfidf(max_df)
TFIDF_NGRAMS = (1, 1)
TOP_FEATURES = 1000    # hashdocs_tfidf(max_features), in the query that cuts the vocabulary
SIM_THRESHOLD = 0.6    # similarity_edges(similarity_threshold)
TERM_SIM_THRESHOLD = 0.5
WORD_SIM_THRESHOLD = 0.8  # of word vectors
LDA_KS = range(2, 8, 2)  # find_topic_num(limit_num=8, start_num=2, step_num=2)
TOPIC_K = 4            # the model shown by the topic views


MAX_STOPWORDS = 10_000     # words of a stop-word table, which become one literal list


def listed(words: DataFrame, most: int = MAX_STOPWORDS) -> tuple:
    """The distinct words of a one-column table, nulls left out; a table of more than ``most`` is refused."""
    word = F.col(words.columns[0])
    got = words.select(word.alias("w")).where(F.col("w").isNotNull()).distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a stop-word table takes at most {most} words")
    return tuple(sorted(r.w for r in got))


class Pipeline:
    """Stages of the tweet chain for one input folder and one parameter set.

    ``Pipeline.of(spark, sf_dir, ...)`` returns the same object for the same
    session, folder and parameters, so a stage written once (a checkpoint in
    the shared folder) is read by every later query, as the reference's
    later stages read the earlier stages' files.
    """

    _shared: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **params) -> "Pipeline":
        """The pipeline of a folder; a new one if the folder's tables have changed."""
        key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(params.items())))
        state = fixtures.input_state(spark, sf_dir)
        if key not in cls._shared or cls._shared[key].state != state:
            cls._shared[key] = cls(spark, sf_dir, **params)
            cls._shared[key].state = state
        return cls._shared[key]

    @classmethod
    def forget(cls) -> None:
        """Start anew: later calls of ``of`` build their stages themselves."""
        cls._shared.clear()

    def __init__(self, spark: SparkSession, sf_dir: str, min_word: int = MIN_WORDS,
                 popular_min: int = POPULAR_MIN, mode: str = TAG_MODE, stopwords=None,
                 use_lexicon: bool | str = False):
        """``stopwords`` is a list, or a one-column table, of words to drop instead of the
        packaged list; with ``use_lexicon`` words are lemmatised through the lexicon table,
        with ``"detached"`` through the base forms of the documents and suffix detachment."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.min_word = min_word
        self.popular_min = popular_min
        self.mode = mode
        if isinstance(stopwords, DataFrame):
            stopwords = listed(stopwords)
        self.stopwords = stopwords
        self.use_lexicon = use_lexicon

    @cached_property
    def lexicon(self) -> DataFrame | None:
        if not self.use_lexicon:
            return None
        if self.use_lexicon != "detached":
            return stage(fixtures.lexicon(self.spark, self.sf_dir), "lexicon")
        from ..functions import text as tx
        from ..operators.lemmas import extend_lexicon

        bases = stage(fixtures.paradigm_lexicon(self.spark, self.sf_dir), "bases")
        return stage(extend_lexicon(bases, self.kept.select(F.explode(tx.split_words(F.col("preprocessed"))).alias("form"))),
                     "lexicon")

    @cached_property
    def lexicon_rows(self) -> int | None:
        return self.lexicon.count() if self.use_lexicon else None

    # -- create() -----------------------------------------------------------
    @cached_property
    def tweets(self) -> DataFrame:
        return fixtures.tweets(self.spark, self.sf_dir)

    @cached_property
    def data(self) -> DataFrame:
        """English tweets, retweet flag, sentinels filled."""
        return ingest.explore(ingest.filter_lang(self.tweets))

    @cached_property
    def data1(self) -> DataFrame:
        """English non-retweets: the base and the lookup side of every enrichment
        join, so it is written once instead of re-derived per branch."""
        return stage(ingest.remove_retweets(self.data), "data1")

    @cached_property
    def data2_raw(self) -> DataFrame:
        return enrich.enrich_tweets(self.data1)

    @cached_property
    def data2(self) -> DataFrame:
        d = ingest.format_dates(self.data2_raw)
        return d.select("id", "created_at", "text", "hashtags", "mentions")

    # -- preprocess() -------------------------------------------------------
    @cached_property
    def cleaned(self) -> DataFrame:
        """The rows of ``staged`` as they are written, each text once.

        Without a lexicon the token lists of ``df`` are worked out in the same
        pass and written with them (null for a row that fails the ASCII
        filters), so that ``df`` is not written a second time.
        """
        rows = clean.clean_rows(self.data2, self.min_word, self.mode)
        if not self.use_lexicon:
            from ..operators.tokens import tokenize_lemma

            passes = clean.is_ascii_row(F.col("preprocessed"), F.col("hashtags"))
            rows = tokenize_lemma(rows, stopwords=self.stopwords).withColumn("tokenized", F.when(passes, F.col("tokenized")))
        return stage(rows, "cleaned")

    @cached_property
    def staged(self) -> DataFrame:
        """Cleaned, de-duplicated, minimum words; before the ASCII filters."""
        return clean.hashtag_decision(self.cleaned.drop("tokenized"), self.mode)

    @cached_property
    def kept(self) -> DataFrame:
        """Rows that pass the ASCII filters."""
        return clean.ascii_tags(clean.ascii_only(self.staged))

    @cached_property
    def df(self) -> DataFrame:
        from ..operators.tokens import tokenize_lemma

        if not self.use_lexicon:
            rows = self.cleaned.where(F.col("tokenized").isNotNull())
        else:
            kept = clean.ascii_tags(clean.ascii_only(self.cleaned))
            rows = stage(tokenize_lemma(kept, stopwords=self.stopwords, lexicon=self.lexicon,
                                        lexicon_rows=self.lexicon_rows), "df")
        return clean.hashtag_decision(rows, self.mode).select(*self.staged.columns, "tokenized")

    @cached_property
    def phrases(self) -> DataFrame:
        """Phrase model learned on the cleaned rows before the ASCII filters."""
        from ..operators.tokens import mine_bigrams

        return stage(mine_bigrams(self.staged), "phrases")

    @cached_property
    def phrased(self) -> DataFrame:
        """``(id, spacy_lemmatized)``: phrases fused, short tokens dropped."""
        from ..operators.tokens import apply_bigrams

        n = self.phrases.count()        # reads the written phrase table
        return stage(apply_bigrams(self.df, self.phrases, stopwords=self.stopwords, lexicon=self.lexicon,
                                   phrase_rows=n, lexicon_rows=self.lexicon_rows), "phrased")

    @cached_property
    def df_phrased(self) -> DataFrame:
        """``df`` plus ``spacy_lemmatized``."""
        return self.df.join(self.phrased, "id")

    # -- hashtag_explore() --------------------------------------------------
    @cached_property
    def incidence(self) -> DataFrame:
        return tags.tag_incidence(self.df)

    @cached_property
    def counts(self) -> DataFrame:
        return tags.tag_counts(self.incidence)

    @cached_property
    def popular(self) -> DataFrame:
        return tags.popular_tags(self.counts, self.popular_min)

    @cached_property
    def nodes_and_size(self):
        return tags.graph_nodes(self.popular)

    @property
    def nodes(self) -> DataFrame:
        return self.nodes_and_size[0]

    @property
    def n_nodes(self) -> int:
        return self.nodes_and_size[1]

    @cached_property
    def reduced(self) -> DataFrame:
        return tags.reduce_incidence(self.incidence, self.popular)

    @cached_property
    def edges(self) -> DataFrame:
        t = tags.tagged_tweets(self.df).select("id", "hashtags")
        t = t.withColumn("hashtags", F.transform("hashtags", tags.normalize_tag))
        return graph.popular_edges(graph.cooccur_in_rows(t), self.nodes, self.n_nodes)

    @cached_property
    def weighted(self) -> DataFrame:
        return stage(graph.edge_weights(self.edges), "weighted")

    # -- hashdocs_tfidf() and similarity -----------------------------------
    @cached_property
    def segments(self) -> DataFrame:
        return stage(docs.tag_segments(self.df, self.popular), "segments")

    @cached_property
    def segments_phrased(self) -> DataFrame:
        """``segments`` with the phrase lists, the third text choice."""
        return stage(docs.tag_segments(self.df_phrased, self.popular), "segments")

    def segments_of(self, text_col: str) -> DataFrame:
        return self.segments_phrased if text_col == "spacy_lemmatized" else self.segments

    def doc_segments(self, text_col: str = "tokenized") -> DataFrame:
        return docs.tag_doc_segments(self.segments_of(text_col), self.nodes, self.n_nodes, text_col)

    def tfidf_of(self, text_col: str = "tokenized", ngrams=TFIDF_NGRAMS, max_features: int | None = None):
        """``(weights, vocabulary)`` of the tag documents, written once per choice."""
        key = (text_col, ngrams, max_features)
        if key not in self._tfidf:
            self._tfidf[key] = similarity.tfidf(self.doc_segments(text_col), max_df=TFIDF_MAX_DF, max_features=max_features,
                                                ngram_range=ngrams, stopwords=self.stopwords)
        return self._tfidf[key]

    @cached_property
    def _tfidf(self) -> dict:
        return {}

    @property
    def tfidf(self) -> DataFrame:
        return self.tfidf_of()[0]

    @cached_property
    def cosine(self) -> DataFrame:
        vocab = self.tfidf_of()[1]
        return stage(similarity.cosine_pairs(self.tfidf, SIM_THRESHOLD, vocab.select("term", "df")), "cosine")

    @cached_property
    def word_pairs(self) -> embeddings.WordPairs:
        """Counts of the words of ``df`` that stand near each other, written once."""
        return embeddings.word_pairs(self.df, "tokenized").staged()

    @cached_property
    def word_pmi(self) -> DataFrame:
        """``(a, b, n, x)``: co-occurrence counts and PPMI of the words of ``df``."""
        return self.word_pairs.pmi()

    @cached_property
    def word_vectors(self) -> DataFrame:
        return self.word_pairs.vectors()

    @cached_property
    def alike_words(self) -> DataFrame:
        """``(t1, t2, s)``: words alike by their vectors."""
        return stage(embeddings.alike_words(self.word_vectors, WORD_SIM_THRESHOLD), "alike_words")

    @cached_property
    def clusters_result(self):
        """``(labels, rounds)``."""
        return graph.tag_clusters(self.nodes, self.weighted, self.n_nodes)

    @cached_property
    def classes(self) -> DataFrame:
        """``(Id, level, cluster)``: the modularity classes of every level."""
        return stage(communities.modularity_classes(self.nodes, self.weighted), "classes")

    @cached_property
    def class_texts(self) -> DataFrame:
        """Documents of the modularity classes of the highest level."""
        labels = stage(communities.last_level(self.classes), "class_labels")
        return stage(docs.cluster_segments(self.segments, self.nodes, labels, self.n_nodes), "class_texts")

    # -- find_topic_num() and topic views --------------------------------
    @cached_property
    def cluster_texts(self) -> DataFrame:
        return stage(docs.cluster_segments(self.segments, self.nodes, self.clusters_result[0], self.n_nodes),
                     "cluster_texts")

    @cached_property
    def lda_corpus(self):
        """``(vectors, vocab, vocabulary size)`` of the cluster documents."""
        counts = (self.cluster_texts.select("doc_key", F.explode("tokens").alias("term"))
                      .groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("count")))
        vectors, vocab, v = topics.bag_of_words(counts)
        # Every LDA iteration and score re-reads the corpus: keep it in memory
        # (spilling to disk); a lost block is read again from the written table.
        from pyspark import StorageLevel

        return vectors.persist(StorageLevel.MEMORY_AND_DISK), vocab, v

    @cached_property
    def lda_prepared(self) -> DataFrame:
        return topics.prepare_texts(self.cluster_texts, ["tag", "text"])

    @cached_property
    def cluster_top_terms(self) -> DataFrame:
        """``(topic, term)``: the most frequent terms of each cluster document.

        Topics that follow from counts alone, to look at clusters and to check
        coherence on.
        """
        counts = (self.cluster_texts.select(F.col("doc_key").alias("topic"), F.explode("tokens").alias("term"))
                      .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")))
        order = Window.partitionBy("topic").orderBy(F.col("n").desc(), F.col("term"))
        return stage(counts.withColumn("r", F.row_number().over(order)).where(
            F.col("r") <= fixed.COHERENCE_TOP_WORDS).select("topic", "term"), "top_terms")

    @cached_property
    def _models(self) -> dict:
        return {}

    def model(self, k: int):
        """The LDA model with k topics, fitted once per pipeline."""
        if k not in self._models:
            self._models[k] = topics.fit_lda(self.lda_corpus[0], k)
        return self._models[k]

    def coherence(self, k: int, model=None) -> DataFrame:
        """c_v per topic of the k-topic model."""
        tw = topics.topic_words(model or self.model(k), self.lda_corpus[1], fixed.COHERENCE_TOP_WORDS)
        return stage(topics.coherence_cv(tw.select("topic", "term"), self.lda_prepared), "coherence")

    def sampled(self, k: int = TOPIC_K, sweeps: int = gibbs.SWEEPS):
        """``(tokens with topics, alpha)`` of the Gibbs sampler over the cluster documents, drawn once per choice."""
        if ("gibbs", k, sweeps) not in self._models:
            _, vocab, v = self.lda_corpus
            tokens = gibbs.token_table(self.cluster_texts, vocab, v, ["tag", "text"])
            self._models["gibbs", k, sweeps] = gibbs.sample_topics(tokens, k, v, sweeps)
        return self._models["gibbs", k, sweeps]

    def sampled_coherence(self, k: int = TOPIC_K, sweeps: int = gibbs.SWEEPS) -> DataFrame:
        """c_v per topic of the sampled topics."""
        words = gibbs.topic_words(self.sampled(k, sweeps)[0], self.lda_corpus[1], fixed.COHERENCE_TOP_WORDS, k)
        return topics.coherence_cv(words.select("topic", "term"), self.lda_prepared)

    @cached_property
    def sweep(self):
        vectors = self.lda_corpus[0]
        self.lda_prepared
        return topics.lda_sweep(vectors, LDA_KS, fit_fn=self.model, coherence_fn=self.coherence)

    @property
    def topic_model(self):
        return self.model(TOPIC_K)


def basket_pipeline(spark: SparkSession, sf_dir: str, tag_col: str = "p_brand"):
    """Incidence, node table and size for the large basket fixture (all tags kept)."""
    inc = fixtures.baskets(spark, sf_dir, tag_col)
    counts = tags.tag_counts(inc)
    nodes, n = tags.graph_nodes(counts)
    return inc, nodes, n
