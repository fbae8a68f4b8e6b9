"""Write every stage table of the pipeline, as the reference writes its files.

data1, data2 (enriched), df (cleaned and tokenised, with phrase lists), dfh
(tagged tweets), dfh_unpoprmvd (tag occurrences of popular tags with their
texts), nodes, edges, hashdocs (tag document sizes) and hashdocs_texts (their
content in long form, for the three text choices), tfidf vectors and
similarity edges go to Parquet; nodes and edges also go to CSV for graph
tools.  Each table is one distributed write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import docs, similarity, tags
from ..sources import io
from .chain import SIM_THRESHOLD, Pipeline


def write_stages(p: Pipeline, out_dir: str, graph_csv: bool = True) -> dict[str, str]:
    out = out_dir.rstrip("/")
    texts = ("text_h_in", *docs.TEXT_CHOICES)
    tables = {
        "data1": p.data1,
        "data2": p.data2,
        "df": p.df_phrased,
        "dfh": tags.tagged_tweets(p.df_phrased).select("id", "hashtags", *texts),
        "dfh_unpoprmvd": tags.reduce_incidence(tags.tag_incidence(p.df_phrased, extra_cols=texts), p.popular),
        "nodes": p.nodes,
        "edges": p.edges,
        "hashdocs": docs.tag_docs(p.segments, p.nodes, p.n_nodes),
        "hashdocs_texts": reduce(DataFrame.unionByName, [
            p.doc_segments(c).select(F.lit(c).alias("text_col"), "doc_id", "text") for c in docs.TEXT_CHOICES]),
        "tfidf": p.tfidf,
        "similarity_edges": similarity.similarity_edges(p.cosine, SIM_THRESHOLD),
    }
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out}/{name}"
        io.write_stage(df, paths[name])
    if graph_csv:
        for name in ("nodes", "edges", "similarity_edges"):
            io.write_graph_csv(tables[name], f"{out}/{name}_csv")
            paths[f"{name}_csv"] = f"{out}/{name}_csv"
    return paths
