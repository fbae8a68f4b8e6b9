"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the shared tables (through the fixture views) and runs the
operator over the whole table.  Array results are joined into strings so
they compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import clean, docs, embeddings, enrich, gibbs, graph, idsets, ingest, similarity, tags, tokens, topic_map, topics, urls
from ..session import stage
from ..sources import fixtures
from . import chain
from .chain import Pipeline, basket_pipeline
from .joins import with_constants

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Computed doubles (sums in engine-specific order) are reported rounded to
# this many decimals, in the query output and in its oracle alike, so the
# comparison does not hinge on the last bit.  The operators themselves keep
# full precision.
DIGITS = 9


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- sources ----------------------------------------------------------------
@query("scan_tweets")
def q_scan_tweets(spark, sf):
    """CSV export round trip: the tweet table written as CSV, scanned back."""
    from ..session import stage_path
    from ..sources import io

    path = stage_path(spark, "tweets_csv")
    io.write_tweets_csv(fixtures.tweets(spark, sf), path)
    return io.scan_tweets(spark, path)


@query("narrowed_table")
def q_narrowed_table(spark, sf):
    """The English tweets with narrowed integer columns: values, and the types they have got."""
    from ..sources.narrow import narrow_types

    cols = ["id", "in_reply_to_status_id", "quoted_status_id", "truncated", "retweet"]
    t = narrow_types(Pipeline.of(spark, sf).data)[0]
    return t.select(*[F.col(c).cast("long").alias(c) for c in cols],
                    F.concat_ws(",", *[F.typeof(c) for c in cols]).alias("types"))


@query("narrow_types")
def q_narrow_types(spark, sf):
    from ..sources.narrow import narrow_plan

    return narrow_plan(Pipeline.of(spark, sf).data)


# ---- ingest ---------------------------------------------------------------
@query("filter_lang")
def q_filter_lang(spark, sf):
    return ingest.filter_lang(fixtures.tweets(spark, sf))


@query("flag_retweets")
def q_flag_retweets(spark, sf):
    return ingest.flag_retweets(fixtures.tweets(spark, sf)).select("id", "retweet")


@query("fill_sentinels")
def q_fill_sentinels(spark, sf):
    d = Pipeline.of(spark, sf).data
    return d.select("id", "in_reply_to_status_id", "quoted_status_id", "truncated", "lat", "retweet")


@query("remove_retweets")
def q_remove_retweets(spark, sf):
    return Pipeline.of(spark, sf).data1


@query("format_dates")
def q_format_dates(spark, sf):
    return ingest.format_dates(Pipeline.of(spark, sf).data1).select("id", "created_at")


@query("corpus_profile")
def q_corpus_profile(spark, sf):
    return ingest.corpus_profile(fixtures.tweets(spark, sf))


@query("corpus_profile_full")
def q_corpus_profile_full(spark, sf):
    return ingest.corpus_profile_full(Pipeline.of(spark, sf).data)


# ---- enrichment -----------------------------------------------------------
@query("enrich_quotes")
def q_enrich_quotes(spark, sf):
    p = Pipeline.of(spark, sf)
    return enrich.enrich_quotes(p.data, p.data1)


@query("enrich_replies")
def q_enrich_replies(spark, sf):
    p = Pipeline.of(spark, sf)
    return enrich.enrich_replies(p.data, p.data1)


@query("enrich_reply_chains")
def q_enrich_reply_chains(spark, sf):
    """Reply enrichment on conversation turns: each turn gets the previous turn's text."""
    c = fixtures.reply_chains(spark, sf)
    data = (c.select("id", F.lit(None).cast("string").alias("created_at"), "text",
                     F.col("in_reply_to_status_id"), F.lit(None).cast("long").alias("quoted_status_id"),
                     F.lit(None).cast("string").alias("hashtags"),
                     F.col("role").alias("mentions"))
             .withColumn("retweet", F.col("text").startswith("RT").cast("int")))
    data = ingest.fill_sentinels(data)
    data1 = ingest.remove_retweets(data)
    return enrich.enrich_replies(data, data1).select("id", "in_reply_to_status_id", "text", "mentions")


@query("enrich_both")
def q_enrich_both(spark, sf):
    p = Pipeline.of(spark, sf)
    return enrich.enrich_both(p.data, p.data1)


@query("enrich_tweets")
def q_enrich_tweets(spark, sf):
    return Pipeline.of(spark, sf).data2


@query("check_enrich")
def q_check_enrich(spark, sf):
    return enrich.check_enrich(Pipeline.of(spark, sf).data)


# ---- cleaning -------------------------------------------------------------
@query("clean_text")
def q_clean_text(spark, sf):
    t = fixtures.tweets(spark, sf)
    return tx.clean_text_df(t.select("id", "text"), "text").select("id", "preprocessed")


@query("expand_contractions")
def q_expand_contractions(spark, sf):
    t = fixtures.tweets(spark, sf)
    return t.select("id", tx.expand_contractions(F.lower(F.col("text"))).alias("expanded"))


@query("tag_text_modes")
def q_tag_text_modes(spark, sf):
    return clean.tag_text_modes(Pipeline.of(spark, sf).data2).select(
        "id", "text_h_in", "text_h_out", "text_h_ne")


@query("tag_lists")
def q_tag_lists(spark, sf):
    d = clean.hashtag_decision(Pipeline.of(spark, sf).data2, "text_h_in")
    return d.select("id", F.array_join("hashtags_list", "|").alias("hashtags_list"), "h_number",
                    F.array_join("mentions_list", "|").alias("mentions_list"), "men_number")


@query("inline_tags")
def q_inline_tags(spark, sf):
    d = clean.hashtag_decision(Pipeline.of(spark, sf).data2, "text_h_ne")
    return d.select("id", F.array_join("hashtags_ne", "|").alias("hashtags_ne"), "h_ne_number")


@query("dedup_first")
def q_dedup_first(spark, sf):
    p = Pipeline.of(spark, sf)
    d = tx.clean_text_df(clean.hashtag_decision(p.data2, p.mode), p.mode)
    return clean.dedup_first(d).select("id", "preprocessed", "hashtags")


@query("min_words")
def q_min_words(spark, sf):
    s = Pipeline.of(spark, sf).staged
    return s.select("id", tx.word_count(F.col("preprocessed")).alias("n_words"))


@query("ascii_only")
def q_ascii_only(spark, sf):
    return clean.ascii_only(Pipeline.of(spark, sf).staged).select("id")


@query("ascii_tags")
def q_ascii_tags(spark, sf):
    return clean.ascii_tags(clean.ascii_only(Pipeline.of(spark, sf).staged)).select("id")


@query("length_hist")
def q_length_hist(spark, sf):
    p = Pipeline.of(spark, sf)
    return clean.length_hist(p.data1, p.data2)


@query("tokenize_lemma")
def q_tokenize_lemma(spark, sf):
    return Pipeline.of(spark, sf).df.select("id", F.array_join("tokenized", " ").alias("tokenized"),
                                          F.size("tokenized").alias("n_tokens"))


@query("tokenize_lemma_lexicon")
def q_tokenize_lemma_lexicon(spark, sf):
    """Token lists lemmatised through the lexicon table."""
    return Pipeline.of(spark, sf, use_lexicon=True).df.select(
        "id", F.array_join("tokenized", " ").alias("tokenized"), F.size("tokenized").alias("n_tokens"))


@query("detached_lemmas")
def q_detached_lemmas(spark, sf):
    """Entries of a lexicon of base forms and of the tweets' words that it lacks."""
    return Pipeline.of(spark, sf, use_lexicon="detached").lexicon


@query("tokenize_lemma_detached")
def q_tokenize_lemma_detached(spark, sf):
    """Token lists lemmatised through base forms and suffix detachment."""
    return Pipeline.of(spark, sf, use_lexicon="detached").df.select(
        "id", F.array_join("tokenized", " ").alias("tokenized"), F.size("tokenized").alias("n_tokens"))


@query("tokenize_stopword_table")
def q_tokenize_stopword_table(spark, sf):
    """Token lists with the stop words of a table."""
    p = Pipeline(spark, sf, stopwords=fixtures.stopword_table(spark, sf))
    kept = clean.ascii_tags(clean.ascii_only(Pipeline.of(spark, sf).staged))
    d = tokens.tokenize_lemma(kept, stopwords=p.stopwords)
    return d.select("id", F.array_join("tokenized", " ").alias("tokenized"), F.size("tokenized").alias("n_tokens"))


@query("mine_bigrams")
def q_mine_bigrams(spark, sf):
    return rounded(Pipeline.of(spark, sf).phrases, "score")


@query("apply_bigrams")
def q_apply_bigrams(spark, sf):
    return phrase_lists(Pipeline.of(spark, sf))


@query("apply_bigrams_lexicon")
def q_apply_bigrams_lexicon(spark, sf):
    """Phrase lists with the word-class filter and lemmas of the lexicon table."""
    return phrase_lists(Pipeline.of(spark, sf, use_lexicon=True))


def phrase_lists(p: Pipeline) -> DataFrame:
    return p.phrased.select("id", F.array_join("spacy_lemmatized", " ").alias("spacy_lemmatized"),
                            F.size("spacy_lemmatized").alias("n_tokens"))


# ---- tags -----------------------------------------------------------------
@query("tagged_tweets")
def q_tagged_tweets(spark, sf):
    t = tags.tagged_tweets(Pipeline.of(spark, sf).df)
    return t.select("id", F.size("hashtags").alias("n_tags"), "h_number")


@query("explode_tags")
def q_explode_tags(spark, sf):
    t = tags.tagged_tweets(Pipeline.of(spark, sf).df).select(F.col("id").alias("tweet_id"), "hashtags")
    return tags.explode_lists(t, ["hashtags"]).select("tweet_id", F.col("hashtags").alias("tag"))


@query("normalize_tags")
def q_normalize_tags(spark, sf):
    return Pipeline.of(spark, sf).incidence


@query("tag_counts")
def q_tag_counts(spark, sf):
    return Pipeline.of(spark, sf).counts


@query("tag_id_sets")
def q_tag_id_sets(spark, sf):
    """The tweet ids of every tag of the basket fixture, by container, read back from bitmaps and arrays."""
    sets = stage(idsets.id_sets(fixtures.baskets(spark, sf)), "id_sets")
    lists = idsets.members(sets).groupBy("tag", "bucket").agg(
        F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    kind = F.when(F.col("bits").isNull(), "ids").otherwise("bits")
    return sets.select("tag", "bucket", "n", kind.alias("kind")).join(lists, ["tag", "bucket"])


@query("tag_overlaps")
def q_tag_overlaps(spark, sf):
    """Shared tweets and Jaccard similarity of all tags that stand together in a basket, from the id sets."""
    inc = fixtures.baskets(spark, sf)
    pairs = graph.cooccur_weighted(inc).select("tag_a", "tag_b")
    return rounded(idsets.overlaps(stage(idsets.id_sets(inc), "id_sets"), pairs), "jaccard")


@query("popular_tags")
def q_popular_tags(spark, sf):
    return Pipeline.of(spark, sf).popular


@query("graph_nodes")
def q_graph_nodes(spark, sf):
    return Pipeline.of(spark, sf).nodes


@query("top_tags")
def q_top_tags(spark, sf):
    return tags.top_tags(Pipeline.of(spark, sf).popular)


@query("cooccur_edges")
def q_cooccur_edges(spark, sf):
    return Pipeline.of(spark, sf).edges


@query("cooccur_weighted")
def q_cooccur_weighted(spark, sf):
    inc, nodes, n = basket_pipeline(spark, sf, "p_brand")
    return graph.cooccur_weighted(inc, nodes, n)


@query("url_by_tagcount")
def q_url_by_tagcount(spark, sf):
    return rounded(tags.url_by_tagcount(Pipeline.of(spark, sf).df), "url_percent_withurl")


@query("extract_urls")
def q_extract_urls(spark, sf):
    return tags.extract_urls(fixtures.page_texts(spark, sf), "page_id")


@query("bare_urls")
def q_bare_urls(spark, sf):
    """URLs of page texts, bare domains included; the suffixes are those of the pages' own hosts."""
    texts = fixtures.bare_page_texts(spark, sf)
    return urls.url_lists(texts, urls.urls(texts, fixtures.page_suffixes(spark, sf), "page_id"), "page_id")


@query("tag_report")
def q_tag_report(spark, sf):
    p = Pipeline.of(spark, sf)
    return tags.tag_report(p.df, p.incidence, p.reduced, p.edges)


# ---- documents and similarity --------------------------------------------
@query("tag_docs")
def q_tag_docs(spark, sf):
    p = Pipeline.of(spark, sf)
    return docs.tag_docs(p.segments, p.nodes, p.n_nodes)


@query("tag_doc_texts")
def q_tag_doc_texts(spark, sf):
    """The content of the tag documents for the three text choices, in long form."""
    p = Pipeline.of(spark, sf)
    out = [p.doc_segments(c).select(F.lit(c).alias("text_col"), "doc_id", "text") for c in docs.TEXT_CHOICES]
    return reduce(DataFrame.unionByName, out)


@query("tfidf")
def q_tfidf(spark, sf):
    return rounded(Pipeline.of(spark, sf).tfidf, "weight")


@query("tfidf_top_terms")
def q_tfidf_top_terms(spark, sf):
    """TF-IDF with the vocabulary cut to the most frequent terms (max_features)."""
    return rounded(Pipeline.of(spark, sf).tfidf_of(max_features=chain.TOP_FEATURES)[0], "weight")


@query("tfidf_ngrams")
def q_tfidf_ngrams(spark, sf):
    """TF-IDF over single terms and pairs of adjacent terms."""
    return rounded(Pipeline.of(spark, sf).tfidf_of(ngrams=(1, 2))[0], "weight")


@query("cosine_pairs")
def q_cosine_pairs(spark, sf):
    return rounded(Pipeline.of(spark, sf).cosine, "Weight")


@query("similarity_edges")
def q_similarity_edges(spark, sf):
    return rounded(similarity.similarity_edges(Pipeline.of(spark, sf).cosine, chain.SIM_THRESHOLD), "Weight")


@query("check_pairs")
def q_check_pairs(spark, sf):
    p = Pipeline.of(spark, sf)
    return similarity.check_pairs(similarity.similarity_edges(p.cosine, chain.SIM_THRESHOLD), p.n_nodes)


@query("pair_candidates")
def q_pair_candidates(spark, sf):
    """What the pair search joins and verifies, against its results."""
    p = Pipeline.of(spark, sf)
    return similarity.candidate_report(p.tfidf, chain.SIM_THRESHOLD, p.tfidf_of()[1].select("term", "df"))


@query("soft_cosine_pairs")
def q_soft_cosine_pairs(spark, sf):
    """Soft cosine over the most frequent terms (max_features): similar terms need documents in common."""
    w, _ = Pipeline.of(spark, sf).tfidf_of(max_features=chain.TOP_FEATURES)
    s = similarity.term_similarity(w, chain.TERM_SIM_THRESHOLD)
    return rounded(similarity.soft_cosine_pairs(w, s, chain.SIM_THRESHOLD), "Weight")


@query("soft_cosine_pairs_all")
def q_soft_cosine_pairs_all(spark, sf):
    """Soft cosine over the whole vocabulary."""
    w = similarity.merge_alike_terms(Pipeline.of(spark, sf).tfidf)
    s = similarity.term_similarity(w, chain.TERM_SIM_THRESHOLD)
    return rounded(similarity.soft_cosine_pairs(w, s, chain.SIM_THRESHOLD), "Weight")


@query("word_cooccurrence")
def q_word_cooccurrence(spark, sf):
    """Words of cleaned tweets that stand within five places of each other, and their PPMI."""
    return rounded(Pipeline.of(spark, sf).word_pmi, "x")


@query("alike_words")
def q_alike_words(spark, sf):
    """Pairs of words whose vectors have a cosine of 0.8 or more."""
    return Pipeline.of(spark, sf).alike_words.select("t1", "t2", F.round("s", 6).alias("s"))


@query("soft_cosine_words")
def q_soft_cosine_words(spark, sf):
    """Soft cosine of tag documents, words being alike by their vectors."""
    p = Pipeline.of(spark, sf)
    found = similarity.soft_cosine_pairs(p.tfidf, embeddings.both_ways(p.alike_words), chain.SIM_THRESHOLD)
    return found.select("Source", "Target", F.round("Weight", 6).alias("Weight"))


@query("word_freq")
def q_word_freq(spark, sf):
    return docs.word_freq(Pipeline.of(spark, sf).df, "tokenized")


@query("word_freq_top")
def q_word_freq_top(spark, sf):
    """The words a word cloud would show."""
    return docs.word_freq(Pipeline.of(spark, sf).df, "tokenized", k=fixed.WORDCLOUD_MAX_WORDS)


POOLS = (("all", "tokenized"), ("tagged", "tokenized"), ("tag", "tokenized"), ("cluster", "tokenized"),
         ("all", "spacy_lemmatized"), ("tag", "spacy_lemmatized"), ("tag", "preprocessed"))


@query("pool_documents")
def q_pool_documents(spark, sf):
    p = Pipeline.of(spark, sf)
    out = []
    for scheme, text in POOLS:
        df = p.df.join(p.phrased, "id") if text == "spacy_lemmatized" else p.df
        labels = p.clusters_result[0] if scheme == "cluster" else None
        c = docs.pool_term_counts(df, scheme, p.segments_of(text), p.nodes, p.n_nodes, labels, text)
        out.append(docs.pool_summary(c, scheme, text))
    return reduce(DataFrame.unionByName, out)


# ---- clusters (iterative) ---------------------------------------------------
@query("tag_clusters")
def q_tag_clusters(spark, sf):
    p = Pipeline.of(spark, sf)
    return p.clusters_result[0].join(p.nodes.select("Id", "Name"), "Id").select("Id", "Name", "cluster")


@query("modularity")
def q_modularity(spark, sf):
    p = Pipeline.of(spark, sf)
    return rounded(graph.modularity(p.weighted, p.clusters_result[0]).select("n_clusters", "modularity"), "modularity")


@query("modularity_classes")
def q_modularity_classes(spark, sf):
    """The modularity class of every tag at every level."""
    p = Pipeline.of(spark, sf)
    return p.classes.join(p.nodes.select("Id", "Name"), "Id").select("Id", "Name", "level", "cluster")


@query("modularity_levels")
def q_modularity_levels(spark, sf):
    """Clusters and modularity of label propagation (level 0) and of every level of the modularity classes."""
    p = Pipeline.of(spark, sf)
    lpa = p.clusters_result[0].select("Id", F.lit(0).alias("level"), "cluster")
    return rounded(graph.modularity_by(p.weighted, lpa.unionByName(p.classes), "level"), "modularity")


@query("class_docs")
def q_class_docs(spark, sf):
    """The documents of the modularity classes: terms and tokens of each."""
    c = Pipeline.of(spark, sf).class_texts.select(F.col("doc_key").alias("cluster"), F.explode("tokens").alias("term"))
    c = c.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("count"))
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("count").alias("n_tokens"))


@query("cluster_docs")
def q_cluster_docs(spark, sf):
    c = Pipeline.of(spark, sf).cluster_texts.select(F.col("doc_key").alias("cluster"), F.explode("tokens").alias("term"))
    c = c.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("count"))
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("count").alias("n_tokens"))


@query("cluster_summary")
def q_cluster_summary(spark, sf):
    """Number of tag clusters and number of labelled tag rows (popular-tag occurrences)."""
    p = Pipeline.of(spark, sf)
    n = p.clusters_result[0].agg(F.countDistinct("cluster").alias("n_clusters"))
    return with_constants(n, p.reduced.agg(F.count(F.lit(1)).alias("labeled_rows")))


@query("coherence_terms")
def q_coherence_terms(spark, sf):
    """c_v of the most frequent terms of each cluster document, over the cluster documents."""
    p = Pipeline.of(spark, sf)
    c = topics.coherence_cv(p.cluster_top_terms, p.lda_prepared)
    return c.select("topic", F.round("coherence", 6).alias("coherence"))


@query("source_distances")
def q_source_distances(spark, sf):
    """Divergence of the word distributions of each two document sources (a null source counts as empty)."""
    counts = fixtures.source_words(spark, sf).groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    shares = stage(topic_map.shares_of(counts, "source", "word"), "shares")
    return topic_map.distances(shares).select("a", "b", "shared", F.round("divergence", DIGITS).alias("divergence"))


# ---- topic models (fitted: no SQL oracle) --------------------------
@query("topic_map")
def q_topic_map(spark, sf):
    """Share, place on the map and rank of each topic of the fitted model."""
    counts = stage(topics.topic_counts(Pipeline.of(spark, sf).topic_model).where("id < 0"), "topic_counts")
    m = topic_map.topic_map(counts, "topic", "id")
    return m.select("topic", *[F.round(c, DIGITS).alias(c) for c in ("share", "x", "y")], "rank")


@query("lda_sweep")
def q_lda_sweep(spark, sf):
    return Pipeline.of(spark, sf).sweep[0]


@query("coherence_cv")
def q_coherence_cv(spark, sf):
    return Pipeline.of(spark, sf).coherence(chain.TOPIC_K)


@query("gibbs_topics")
def q_gibbs_topics(spark, sf):
    """Topics drawn by the Gibbs sampler: alpha, tokens, share and c_v of each."""
    p = Pipeline.of(spark, sf)
    state, alpha = p.sampled()
    sizes = gibbs.topic_sizes(state, alpha).join(p.sampled_coherence(), "topic", "left")
    return sizes.select("topic", F.round("alpha", 6).alias("alpha"), "n_tokens", F.round("share", DIGITS).alias("share"),
                        F.round("coherence", 6).alias("coherence"))


@query("gibbs_terms")
def q_gibbs_terms(spark, sf):
    """The 100 terms most often drawn in each topic."""
    p = Pipeline.of(spark, sf)
    return gibbs.topic_words(p.sampled()[0], p.lda_corpus[1], fixed.TOPIC_TERMS, chain.TOPIC_K)


@query("topic_terms")
def q_topic_terms(spark, sf):
    p = Pipeline.of(spark, sf)
    return topics.topic_terms(p.topic_model, p.lda_corpus[1])


@query("topic_relevance")
def q_topic_relevance(spark, sf):
    """Relevance of every term to every topic."""
    p = Pipeline.of(spark, sf)
    return topics.topic_relevance(p.topic_model, p.lda_corpus[1])


@query("topic_relevance_top")
def q_topic_relevance_top(spark, sf):
    """The 30 most relevant terms of each topic, as a topic browser lists them."""
    p = Pipeline.of(spark, sf)
    return topics.topic_relevance(p.topic_model, p.lda_corpus[1], top=30)
