"""Command line: ``python -m sextant.cli VERB ...``.

Exit codes: 0 done; 1 what was named can't be used; 2 wrong use, drift under ``--strict``, files that can't be reached; 3 names missing under
``--strict-names``; 4 a projection that was stopped early."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
import uuid
from dataclasses import replace
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import chunks
from sextant.operators import ann, clusters, compare, context, delta, memory, projection, retrieval
from sextant.plans import deep, synthesis
from sextant.scratch import written
from sextant.sources import convert, encoders, files, model, remote, store


class Failed(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def encoder_of(spec: str) -> encoders.Encoder:
    """``hashing:64`` for tests, ``onnx:MODEL,TOKENIZER,DIM[,REVISION]``, or ``package.module:factory``."""
    kind, _, rest = spec.partition(":")
    if kind == "hashing":
        return encoders.HashingEncoder(int(rest or 64))
    if kind == "onnx":
        path, tokenizer, dim, *revision = rest.split(",")
        return encoders.OnnxEncoder(path, tokenizer, int(dim), *revision)
    return getattr(importlib.import_module(kind), rest)()


def _load(spark: SparkSession, path: str) -> model.KnowledgeModel:
    try:
        return model.read(spark, path)
    except (FileNotFoundError, ValueError) as e:
        raise Failed(1, f"{path}: {e}") from e


def _client(spec: str | None) -> deep.Model:
    if not spec:
        raise Failed(2, "--client names the language model: package.module:function(instructions, prompt) -> (text, tokens in, tokens out)")
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _say(df: DataFrame, form: str = "json") -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(True), default=str, ensure_ascii=False) if form == "json" else "\t".join(str(x) for x in row))


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _build(spark, sources, output, root, extensions, least, most, encoder, mode="local", url_base=None, kind="corpus") -> int:
    if mode == "remote" and not url_base:
        raise Failed(2, "remote texts need --remote-url-base")
    root = os.path.abspath(root or files.common_root(sources))
    texts, bad = files.walk(spark, sources, root, extensions)
    for r in bad.toLocalIterator():
        print(f"skipped {r.source_file}: {r.reason}", file=sys.stderr)
    if texts.isEmpty():
        raise Failed(1, "no texts")
    passages = chunks.registry(texts, least, most)
    if passages.isEmpty():
        raise Failed(1, "no passages")
    rows = passages.drop("text").join(encoders.encoded(passages.select("passage_id", "text"), encoder), "passage_id")
    rows = written(rows, "rows")
    meta = model.new_metadata(mode, encoder.dim, encoder.name, encoder.revision, _now(), sources=[os.path.abspath(s) for s in sources], root=root, extensions=list(extensions), least=least, most=most) | {"kind": kind}
    if ann.should_index(rows.count()):
        at = f"{output}/ann-{uuid.uuid4().hex}"
        ann.save(ann.build(rows.drop("content_hash", "passage_id", "char_length")), at)
        meta |= {"ann": {"vector": at}}
    return model.write(model.KnowledgeModel(rows, meta, texts if mode == "bundled" else None, remote.compose_manifest(texts, url_base) if mode == "remote" else None), output)


def build(spark, a) -> int:
    print(f"version {_build(spark, a.sources, a.output, a.source_root, tuple(a.ext or files.EXTENSIONS), a.min_chars, a.max_chars, encoder_of(a.encoder), a.store_mode, a.remote_url_base, a.kind)} of {a.output}")
    return 0


def init_project(spark, a) -> int:
    sources = a.source or files.project_sources(os.getcwd())
    if not sources:
        raise Failed(2, "nothing to read here")
    out = a.output or os.path.basename(os.getcwd()) + ".km"
    _build(spark, sources, out, os.getcwd(), files.EXTENSIONS, chunks.LEAST, chunks.MOST, encoder_of(a.encoder))
    if not a.no_primer:
        _put(a.primer, _primer(spark, _load(spark, out), encoder_of(a.encoder), []))
    return 0


def _hits(spark, km, encoder, questions, k, root=None):
    """Verified hits, metrics and questions. Only the files of the hits are read."""
    asked = encoders.query_table(spark, encoder, questions, km.metadata)
    band = km.band()
    asked = km.queries_for(asked)
    index = km.metadata.get("ann", {}).get(band)
    if index:
        found = ann.retrieve(km.passages, asked, k, ann.load(spark, index), vector=band)
        found = km.passages.select(*retrieval.CITATION).join(F.broadcast(found), "passage_idx")
    else:
        found = retrieval.search(km.passages, asked, k, vector=band, hits_at_most=k * len(questions))
    found = spark.createDataFrame(found.collect(), found.schema)  # at most k rows a question
    try:
        now = store.open_sources(km, root, only=sorted({r.source_file for r in found.select("source_file").distinct().collect()}))
    except ValueError as e:
        raise Failed(1, str(e)) from e
    hits = retrieval.verified(found, now)
    return hits, retrieval.with_all_queries(retrieval.confidence(hits), asked), asked.select("query_id", "question")


def search(spark, a) -> int:
    km = _load(spark, a.model)
    hits, metrics, asked = _hits(spark, km, encoder_of(a.encoder), [a.query], a.top_k, a.source_root)
    if a.verified_only:
        hits = retrieval.verified_only(hits)
    if a.format != "context":
        _say(hits.orderBy("rank").select("rank", "score", "source_file", "char_offset", "char_length", "drift_status", "passage_id", "text"), a.format)
        return 0
    row = context.contexts(hits, metrics, asked, a.mode, a.token_budget * context.CHARS_PER_TOKEN).first()
    print(row.context)
    return 3 if a.strict_names and row.missing_names else 0


def skill_context(spark, a) -> int:
    km = _load(spark, a.model)
    hits, metrics, asked = _hits(spark, km, encoder_of(a.encoder), a.query, a.top_k, a.source_root)
    drifted = metrics.where("drift_fraction > 0").count()
    if drifted and a.strict:
        raise Failed(2, f"{drifted} questions have drifted hits")
    rows = context.question_blocks(hits, metrics, asked, a.mode, a.token_budget * context.CHARS_PER_TOKEN).orderBy("query_id").collect()
    if drifted:
        print("> Some passages have drifted since the model was built.\n")
    print("\n\n".join(r.block for r in rows))
    return 3 if a.strict_names and any(r.missing_names for r in rows) else 0


def profile(spark, a) -> int:
    km = _load(spark, a.model)
    counts = retrieval.profile(km.passages)
    out = {"passages": km.passages.count(), "files": counts.count(), "bands": km.metadata["bands"], "encoder": km.metadata.get("encoder"), "mode": km.mode}
    if not a.no_drift:
        out["drift"] = {r.drift_status: r.n for r in retrieval.drift_counts(retrieval.drift_report(km.passages, store.open_sources(km, a.source_root))).collect()}
    print(json.dumps(out))
    return 0


def compare_models(spark, a) -> int:
    x, y = _load(spark, a.a), _load(spark, a.b)
    try:
        same = compare.require_pair(x.metadata, y.metadata, strict=False)
    except compare.Mismatch as e:
        raise Failed(1, str(e)) from e
    pair = (k.passages.select(F.col("passage_idx").alias("id"), "vector") for k in (x, y))
    print(json.dumps(compare.compare(*pair, a.sample).first().asDict() | {"revision_match": same}))
    return 0


def _primer(spark, km, encoder, questions: list[str], root: str | None = None) -> str:
    middle = clusters.centroid(km.passages.select("vector")).select(F.lit(0).cast("long").alias("query_id"), "vector")
    sources = store.open_sources(km, root)
    top = context.primer(retrieval.evidence(km.passages, sources, middle)[0], 600 * context.CHARS_PER_TOKEN).orderBy("rank").collect()
    out = ["# Primer", "", "## Landscape", ""]
    out += [f"- **{r.source_file}** ({r.score:.3f}): {' '.join(r.text.split())[:600]}" for r in top] or ["_nothing verified_"]
    out += ["", "## Structure", ""] + [f"- `{r.source_file}`: {r.n_passages} passages" for r in context.structure(km.passages).orderBy("place").collect()]
    if questions:
        hits, _, _ = _hits(spark, km, encoder, questions, 5, root)
        rows = context.primer(hits, context.evidence_budget(len(questions))).orderBy("query_id", "rank").collect()
        out += ["", "## Evidence"]
        for i, q in enumerate(questions):
            out += ["", f"### {q}", *(f"- **{r.source_file}** ({r.score:.3f}): {' '.join(r.text.split())[:400]}" for r in rows if r.query_id == i)]
    return "\n".join(out) + "\n"


def _put(path: str | None, text: str) -> None:
    if path is None:
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def summary(spark, a) -> int:
    _put(a.output, _primer(spark, _load(spark, a.model), encoder_of(a.encoder), a.query or [], a.source_root))
    return 0


def install_encoder(spark, a) -> int:
    e = encoder_of(a.encoder)
    try:
        got = e.encode(["a test"])
    except Exception as x:
        raise Failed(1, f"{a.encoder}: {x}") from x
    print(json.dumps({"name": e.name, "revision": e.revision, "dim": int(got.shape[1])}))
    return 0


def _changed(counts: dict) -> bool:
    return any(counts[b] for b in ("updated", "added", "removed"))


def refresh(spark, a) -> int:
    km = _load(spark, a.model)
    if km.mode != "local":
        raise Failed(1, f"texts are {km.mode}; only local ones are refreshed")
    was = km.metadata["build_config"]
    texts, _ = files.walk(spark, was["sources"], a.source_root or was["root"], tuple(was["extensions"]))
    now = chunks.candidates(texts, was["least"], was["most"])
    counts = {r.bucket: r.n for r in delta.bucket_counts(delta.bucketise(km.passages, now)).collect()}
    print(json.dumps(counts))
    if a.dry_run or not (_changed(counts) or (a.discard_optimised and "optimised" in km.passages.columns)):
        return 0
    _renew(spark, a, km, delta.apply_delta(km.passages, now, encoders.encode_with(encoder_of(a.encoder))), km.manifest)
    return 0


def _renew(spark, a, km, passages, manifest) -> None:
    """Writes renewed base vectors; an optimised band is projected again through its old weights, or let go."""
    w = km.projection
    km = replace(km, metadata={k: v for k, v in km.metadata.items() if k != "ann"})  # an index of the old passages
    base = replace(model.without_optimised(km), passages=passages, manifest=manifest)
    model.write(model.with_optimised(base, w) if w and not a.discard_optimised else base, a.model)


def sync(spark, a) -> int:
    km = _load(spark, a.model)
    if km.mode != "remote":
        raise Failed(1, f"texts are {km.mode}, not remote")
    encode = encoders.encode_with(encoder_of(a.encoder))
    if a.catalog:
        catalog = spark.read.schema("source_file string, url string, sha256 string").json(a.catalog)
        change = delta.manifest_delta(km.manifest, catalog)
        got = remote.fetched(catalog.join(delta.changed_files(change), "source_file"))
        wrong = got.join(catalog.select("source_file", "sha256"), "source_file").where("text is not null and sha2(text, 256) <> sha256")
        if not wrong.isEmpty():
            raise Failed(1, f"{wrong.first().source_file} isn't what the catalog says")
        lost = got.where("text is null").select("source_file", F.lit("unavailable").alias("bucket"))
        change = change.join(lost, "source_file", "left_anti").unionByName(lost)
    else:
        got = remote.fetched(km.manifest)
        change = delta.poll_delta(km.manifest, got)
        got = got.join(delta.changed_files(change), "source_file", "left_semi")
    print(json.dumps({r.bucket: r["count"] for r in change.groupBy("bucket").count().collect()}))
    if a.dry_run:
        return 0
    was = km.metadata["build_config"]
    try:
        passages, manifest = delta.sync(km.passages, km.manifest, change, got, encode, a.allow_unavailable, was["least"], was["most"])
    except delta.Unavailable as e:
        raise Failed(2, f"can't reach {e}") from e
    _renew(spark, a, replace(km, metadata=km.metadata | {"pinned_ref": remote.poll_ref(manifest)}), passages, manifest)
    return 0


def freshness(spark, a) -> int:
    km = _load(spark, a.model)
    if km.mode != "remote":
        raise Failed(1, f"texts are {km.mode}, not remote")
    counts = {r.drift_status: r["count"] for r in delta.freshness(km.manifest, remote.fetched(km.manifest)).groupBy("drift_status").count().collect()}
    print(json.dumps(counts))
    return 2 if set(counts) - {"verified"} else 0


def optimise(spark, a) -> int:
    """Queries are written by the caller's language model, or come from JSON lines of ``query`` and ``passage_idx``."""
    km = _load(spark, a.model)
    if a.estimate:
        n = projection.stratified_sample(km.passages.select("passage_idx", "source_file")).count()
        print(json.dumps({"passages": n, "usd": projection.estimated_cost(n), "seconds": projection.estimated_seconds(n, n)}))
        return 0
    if a.client:
        texts = retrieval.verified_only(retrieval.verified(km.passages.select(*retrieval.CITATION), store.open_sources(km, a.source_root)))
        rows = synthesis.synthesised(texts, _client(a.client), f"{a.model}/queries")
    elif a.queries:
        rows = spark.read.schema("query string, passage_idx long").json(a.queries)
    else:
        raise Failed(2, "queries come from --client or --queries")
    kept = rows.where(projection.usable_query("query")).join(km.passages.select("passage_idx", "vector"), "passage_idx").orderBy("passage_idx", "query").limit(projection.SAMPLE).collect()
    if len(kept) < a.least_queries:
        raise Failed(1, f"{len(kept)} usable queries; {a.least_queries} are needed")
    q = encoder_of(a.encoder).encode([r.query for r in kept]).astype(float)
    ids = sorted({r.passage_idx for r in kept})
    asked = spark.createDataFrame([(i, v.tolist(), r.passage_idx) for i, (v, r) in enumerate(zip(q, kept))], "query_id long, vector array<double>, positive long")
    negatives = projection.hard_negatives(asked, km.passages.select("passage_idx", "vector"))
    neg = {}
    for r in negatives.collect():
        neg.setdefault(r.query_id, {})[r.place] = r.passage_idx
    every = sorted({*ids, *(p for d in neg.values() for p in d.values())})
    table = {r.passage_idx: r.vector for r in km.passages.select("passage_idx", "vector").where(F.col("passage_idx").isin(*every)).collect()}
    at = {p: i for i, p in enumerate(every)}
    use = [i for i in range(len(kept)) if i in neg]
    dims = tuple(d for d in projection.DIMS if d <= q.shape[1]) or (q.shape[1],)
    got = projection.train(q[use], np.array([table[p] for p in every], float), np.array([at[kept[i].passage_idx] for i in use]), np.array([[at[neg[i][k]] for k in range(projection.NEGATIVES)] for i in use]), dims)
    print(json.dumps({"recall_at_1": got.recall, "loss": got.losses[-1], "stopped": got.stopped}))
    if got.stopped:
        return 4
    model.write(model.with_optimised(model.without_optimised(km), got.weights.tolist()), a.model)
    return 0


def convert_model(spark, a) -> int:
    km = _load(spark, a.model)
    if a.mode == km.mode:
        print(f"texts are {a.mode} already")
        return 0
    if a.mode == "remote" and not a.remote_url_base:
        raise Failed(1, "remote texts need --remote-url-base")
    try:
        out = convert.converted(km, a.mode, store.open_sources(km, a.source_root), a.remote_url_base)
    except convert.Drifted as e:
        raise Failed(2, f"drifted: {e}") from e
    if a.mode == "local" and a.source_root:
        out = replace(out, metadata=out.metadata | {"build_config": out.metadata.get("build_config", {}) | {"root": os.path.abspath(a.source_root)}})
    model.write(out, a.output or a.model)
    return 0


def deep_search(spark, a) -> int:
    km, encoder = _load(spark, a.model), encoder_of(a.encoder)
    got = deep.deep_search(spark, a.question, lambda q: _hits(spark, km, encoder, [q], a.top_k, a.source_root)[0].orderBy("rank"), _client(a.client), a.max_hops, a.strict_names)
    print(json.dumps({"answer": got.answer, "hops": [vars(h) for h in got.hops], "missing": got.missing, "cost_usd": got.cost_usd}) if a.format == "json" else got.answer)
    return 3 if got.aborted else 2 if any(h.kind == "search_failed" for h in got.hops) else 0


def memory_command(spark, a) -> int:
    rows = store.read_memory(spark, a.memory_root)
    if a.what == "add":
        text = sys.stdin.read() if a.text == "-" else a.text
        if not text.strip():
            raise Failed(1, "nothing to add")
        next_id = (rows.agg(F.max("memory_id")).first()[0] if rows.count() else -1) + 1
        entry = [(next_id, text, a.salience, a.source_id, a.session, _now(), a.tier, 1, [float(x) for x in encoder_of(a.encoder).encode([text])[0]])]
        store.append_memory(spark.createDataFrame(entry, memory.SCHEMA), a.memory_root)
        return 0
    elif a.what == "recall":
        try:
            weights = json.loads(a.tier_weights) if a.tier_weights else None
        except ValueError as e:
            raise Failed(1, f"weights: {e}") from e
        found = memory.recall(rows, encoder_of(a.encoder).encode([a.query])[0].tolist(), a.top_k, weights)
        _say(found.join(rows.select("memory_id", "text"), "memory_id").orderBy("rank"), a.format)
        return 0
    elif a.what == "primer":
        lines = memory.primer(rows, a.novelty).orderBy(F.desc("tier"), "rank").collect()
        part = lambda tier: [r.line for r in lines if r.tier == tier] or ["_(empty)_"]
        _put(a.output, "\n".join(["# Memory", "", "## Semantic", "", *part("semantic"), "", "## Episodic", "", *part("episodic"), ""]))
        return 0
    elif a.what == "consolidate":
        after = memory.consolidated(rows, a.recurrence_threshold, a.dup_threshold, a.session)
        if after.count() == rows.count():
            return 0
        rows = after
    else:
        own = rows.where(F.col("tier").isin(*(a.tier or memory.TIERS)))
        rest = rows.where(~F.col("tier").isin(*(a.tier or memory.TIERS)))
        after = memory.collected(own, _now())
        removed = own.count() - after.count()
        print(json.dumps({"removed": removed}))
        if not removed:
            return 0
        rows = rest.unionByName(after)
    store.write_memory(rows, a.memory_root)
    return 0


def _options(p: argparse.ArgumentParser, *needed: str, **others) -> argparse.ArgumentParser:
    """Places and flags by their defaults: False is a switch, a list may repeat, a tuple holds the choices with the default first."""
    for name in needed:
        p.add_argument(name)
    for name, default in others.items():
        flag = ["--" + name.replace("_", "-")]
        if name == "output":
            flag.append("-o")
        if default is False:
            kind = {"action": "store_true"}
        elif isinstance(default, list):
            kind = {"action": "append"}
        elif isinstance(default, tuple):
            kind = {"choices": default, "default": default[0]}
        else:
            kind = {"default": default} | ({} if default is None else {"type": type(default)})
        p.add_argument(*flag, **kind)
    return p


def parser() -> argparse.ArgumentParser:
    top = _options(argparse.ArgumentParser(prog="sextant"), encoder="hashing:64")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *needed: str, **others) -> argparse.ArgumentParser:
        p = _options(verbs.add_parser(name), *needed, **others)
        p.set_defaults(run=run)
        return p

    root = {"source_root": None}
    modes = tuple(context.GATES)
    grounded = {"mode": modes, "token_budget": context.TOKEN_BUDGET, "strict_names": False}
    where = tuple(sorted(model.MODES, key=lambda m: m != "local"))
    p = verb("build", build, store_mode=where, remote_url_base=None, kind=("corpus", "intent"), min_chars=chunks.LEAST, max_chars=chunks.MOST, ext=[], **root)
    p.add_argument("sources", nargs="+")
    p.add_argument("-o", "--output", required=True)
    verb("init-project", init_project, output=None, source=[], primer="primer.md", no_primer=False)
    verb("search", search, "model", "query", top_k=10, format=("text", "json", "context"), verified_only=False, **grounded, **root)
    verb("skill-context", skill_context, "model", top_k=5, strict=False, **grounded, **root).add_argument("--query", action="append", required=True)
    verb("profile", profile, "model", no_drift=False, **root)
    verb("compare", compare_models, "a", "b", sample=512)
    verb("summary", summary, "model", output=None, query=[], **root)
    verb("install-encoder", install_encoder)
    upkeep = {"dry_run": False, "discard_optimised": False}
    verb("refresh", refresh, "model", **upkeep, **root)
    verb("sync", sync, "model", catalog=None, allow_unavailable=False, **upkeep)
    verb("freshness", freshness, "model")
    verb("optimise", optimise, "model", queries=None, client=None, **root, estimate=False, least_queries=128)
    verb("convert", convert_model, "model", remote_url_base=None, output=None, **root).add_argument("--mode", choices=where, required=True)
    verb("deep-search", deep_search, "model", "question", client=None, max_hops=4, top_k=5, format=("text", "json"), strict_names=False, **root)
    what = verb("memory", memory_command, memory_root="./memory").add_subparsers(dest="what", required=True)
    _options(what.add_parser("add"), "text", tier=memory.TIERS, salience=1.0, source_id="", session=None)
    _options(what.add_parser("recall"), "query", top_k=10, tier_weights=None, format=("text", "json"))
    _options(what.add_parser("consolidate"), recurrence_threshold=3, dup_threshold=0.92, session=None)
    _options(what.add_parser("primer"), output=None, novelty=0.3)
    _options(what.add_parser("gc"), tier=[])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sextant").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return a.run(spark, a)
    except Failed as e:
        print(e, file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
