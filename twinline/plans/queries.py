"""The named queries: each takes (spark, sf_dir), reads the given tables, returns a DataFrame.

Array results are rendered as space-joined text, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions import rules as R
from twinline.functions import sequences as Q
from twinline import streaming
from twinline.operators import bleu, clean, encoding, losses, mix, profile, provenance, sketches, split, subword, terms
from twinline.plans import views as V
from twinline.session import exists, materialize, scratch_path, scratch_root
from twinline.sources import fieldlog, sinks, tables

# Parameters of the queries, shared with their SQL counterparts.
VOCAB = subword.VOCAB_SIZE
SEED = 13
WEIGHTS = {"field": 20, "base": 1}
TRAIN_BATCH, VAL_BATCH = 32, 128
REPORT_EVERY = 100
ACCUMULATE, EPOCHS = 1, 20
MARKERS = (*R.MARKERS, ("of", "the"), ("de", "la"), ("und",))

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _joined(array: str | Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def model(spark: SparkSession, sf_dir: str) -> subword.SubwordModel:
    """The vocabulary of a corpus, learned once and kept in the shared folder.

    It is known by the files of the table and their times, so a changed table is learned anew.
    """
    path = _model_path(spark, sf_dir)
    if not exists(spark, f"{path}/vocab/_SUCCESS"):
        subword.learn_bpe(_words(spark, sf_dir), VOCAB).save(spark, path)
    return subword.SubwordModel.load(spark, path)


def _model_path(spark: SparkSession, sf_dir: str) -> str:
    file = [F.col(f"_metadata.{c}").cast("string") for c in ("file_path", "file_size", "file_modification_time")]
    files = V.documents(spark, sf_dir).select(F.xxhash64(*file).alias("h")).distinct()
    known = files.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    return f"{scratch_root(spark)}/twinline/model-{VOCAB}-{known.n}-{known.h}"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the clean corpus, which the vocabulary is learned from."""
    return subword.word_freq(clean.clean_pairs(V.doc_pairs(spark, sf_dir)))


# Sources and sinks


@query
def scan_pairs(spark, sf_dir):
    return V.pairs(spark, sf_dir)


def _written_pairs(spark, sf_dir) -> tuple[str, int]:
    path = scratch_path(spark, "pairs")
    kept = clean.dedup_pairs(V.doc_pairs(spark, sf_dir))
    return path, sinks.write_clean(kept.select("src", "tgt"), path)


@query
def write_clean(spark, sf_dir):
    """Written, then read back raw: nothing is trimmed or lost on the way."""
    scanned = tables.scan_csv(spark, _written_pairs(spark, sf_dir)[0], ["src", "tgt"])
    return tables.quarantine(scanned)[0]


@query
def read_pairs_csv(spark, sf_dir):
    """Unstripped, partly empty pairs written out, then read as clean ones."""
    path = scratch_path(spark, "raw")
    padded = V.raw_doc_pairs(spark, sf_dir).select(
        F.concat(F.lit("  "), "src").alias("src"), F.concat("tgt", F.lit("\t")).alias("tgt")
    )
    sinks.write_clean(padded, path)
    return tables.read_pairs_csv(spark, path, ["src", "tgt"])


def _quarantined(spark, sf_dir) -> tuple[str, dict[str, int]]:
    """Document rows as CSV lines, some with a field too few or too many, scanned once into good and bad."""
    field = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    short = F.col("ord") % 7 == 0
    long = (F.col("ord") % 5 == 0) & ~short
    line = F.concat_ws(
        ",",
        field("category"),
        field("src"),
        F.when(~short, field("tgt")),
        F.when(long, F.lit("surplus")),
    )
    path = scratch_path(spark, "lines")
    V.doc_pairs(spark, sf_dir).select(line.alias("line")).write.option("lineSep", "\n").text(path)
    columns = ["category", "src", "tgt"]
    scanned = tables.scan_csv(spark, path, columns, header="false", lineSep="\n")
    out = scratch_path(spark, "quarantine")
    return out, tables.write_quarantined(scanned, out)


@query
def quarantine_rows(spark, sf_dir):
    """The rows that were set apart and those that were not, from where one pass put them."""
    path, _ = _quarantined(spark, sf_dir)
    rows = spark.read.schema("category string, src string, tgt string, raw string, outcome string").parquet(path)
    good = F.col("outcome") == "good"
    return rows.select("outcome", "category", *[F.when(good, F.col(c)).alias(c) for c in ("src", "tgt")], "raw")


@query
def quarantine_report(spark, sf_dir):
    """Rows by reason, counted while they were written."""
    _, counts = _quarantined(spark, sf_dir)
    return spark.createDataFrame(list(counts.items()), "reason string, n_rows long")


@query
def field_log(spark, sf_dir):
    """Each source as a collection session in a Markdown log, written, and read back as typed rows."""
    counts = V.documents(spark, sf_dir).groupBy("source", F.col("lang").alias("category")).agg(F.count("*").alias("n_pairs"))
    listed = counts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("category", "n_pairs"))).alias("counts"))
    noted = listed.join(V.sessions(spark, sf_dir).withColumnRenamed("session_id", "source"), "source", "left")
    sessions = noted.withColumn("session", F.regexp_extract("source", "([0-9]+)$", 1).cast("int"))
    path = scratch_path(spark, "field-log")
    fieldlog.session_notes(sessions).write.option("lineSep", "\n").text(path)
    return fieldlog.read_field_log(spark, path).select("session", "source", "category", "consent", "n_pairs")


@query
def clean_stream(spark, sf_dir):
    """The documents cleaned as a stream of files, read back from its sink."""
    sink, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, so that a table of one file is found as well as a folder
    streaming.run_clean_stream(spark, source, V.DOCUMENTS, V.document_sides, sink, checkpoint)
    return spark.read.schema("ord long, src string, tgt string").parquet(sink)


@query
def write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    splits = split.stratified_split(V.category_pairs(spark, sf_dir))
    sinks.write_splits(splits.select("split", "category", "src", "tgt"), path)
    return tables.read_pairs_csv(spark, path, ["category", "src", "tgt"], partitions=("split",))


@query
def write_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    sinks.write_corpus(profile.stack_sides(V.doc_pairs(spark, sf_dir)), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n_lines"))


@query
def sink_report(spark, sf_dir):
    """Rows and bytes without the header lines, whose number is the number of files."""
    path, n_rows = _written_pairs(spark, sf_dir)
    report = sinks.sink_report(spark, path, ["src", "tgt"], n_rows)
    header = len('"src","tgt"\n')
    return report.select("n_rows", (F.col("n_bytes") - F.col("n_files") * header).alias("body_bytes"))


# Projections and rules


@query
def normalize_pairs(spark, sf_dir):
    raw = V.pairs(spark, sf_dir).withColumnRenamed("id", "ord")
    return clean.normalize_pairs(raw, "dialect", "english")


@query
def nonempty_pairs(spark, sf_dir):
    return clean.nonempty_pairs(V.raw_doc_pairs(spark, sf_dir)).select("ord", "src", "tgt")


@query
def word_counts(spark, sf_dir):
    return profile.word_counts(V.doc_pairs(spark, sf_dir))


def _packed_sides(spark, sf_dir) -> DataFrame:
    sides = [
        F.struct(F.lit(s).alias("side"), Q.pack(F.col(f"{s}_ids")).alias("packed")) for s in ("src", "tgt")
    ]
    return _encoded(spark, sf_dir).select("ord", F.inline(F.array(*sides)))


@query
def pack_sequences(spark, sf_dir):
    return _packed_sides(spark, sf_dir).select(
        "ord", "side", _joined("packed").alias("packed"), F.size("packed").alias("size")
    )


@query
def shift_targets(spark, sf_dir):
    packed = _encoded(spark, sf_dir).select("ord", Q.pack(F.col("tgt_ids")).alias("packed"))
    return packed.select(
        "ord",
        _joined(Q.decoder_input(F.col("packed"))).alias("decoder_input"),
        _joined(Q.decoder_target(F.col("packed"))).alias("decoder_target"),
    )


@query
def padding_mask(spark, sf_dir):
    mask = Q.padding_mask(F.col("packed"))
    return _packed_sides(spark, sf_dir).select("ord", "side", _joined(F.transform(mask, lambda m: m.cast("int"))).alias("mask"))


@query
def nfkc_fold(spark, sf_dir):
    return subword.folded_words(V.doc_pairs(spark, sf_dir))


def _rule(name: str, test: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        return V.documents(spark, sf_dir).select("doc_id", test(F.col("text")).alias("hit"))

    _REGISTRY[name] = run


_rule("rule_min_words", lambda c: R.has_min_words(c, 3))
_rule("rule_mixed_digits", R.has_mixed_digits)
_rule("rule_url", R.has_url)
_rule("rule_at_hash", R.has_at_or_hash)
_rule("rule_http", R.has_bare_http)
_rule("rule_emoji", R.has_emoji)
_rule("rule_noise", R.has_noise)
_rule("rule_markers", lambda c: R.has_marker(c, MARKERS))


# Cleaning and profiling


@query
def dedup_pairs(spark, sf_dir):
    return clean.dedup_pairs(V.doc_pairs(spark, sf_dir)).select("ord", "src", "tgt", "n_copies")


@query
def clean_pairs(spark, sf_dir):
    return clean.clean_pairs(V.doc_pairs(spark, sf_dir)).select("ord", "src", "tgt")


@query
def cleaning_funnel(spark, sf_dir):
    return clean.cleaning_funnel(V.doc_pairs(spark, sf_dir))


@query
def profile_pairs(spark, sf_dir):
    return profile.profile_pairs(V.raw_doc_pairs(spark, sf_dir).select("ord", "src", "tgt"))


@query
def sample_pairs(spark, sf_dir):
    return profile.sample_pairs(V.doc_pairs(spark, sf_dir)).select("ord", "src", "tgt")


@query
def stack_sides(spark, sf_dir):
    return profile.stack_sides(V.raw_doc_pairs(spark, sf_dir))


@query
def corpus_sides(spark, sf_dir):
    return profile.corpus_sides(V.raw_doc_pairs(spark, sf_dir))


@query
def length_profile(spark, sf_dir):
    return profile.length_profile(V.doc_pairs(spark, sf_dir))


@query
def sketched_sentences(spark, sf_dir):
    """Sentences by side from the stored sketches of four deliveries; the sketched figures are tested against exact ones."""
    return _merged_deliveries(spark, sf_dir).select("side", "n_sentences")


@query
def sketched_profile(spark, sf_dir):
    """Length quantiles and distinct words by side, merged from the stored sketches of four deliveries."""
    return sketches.sketch_report(_merged_deliveries(spark, sf_dir))


def _merged_deliveries(spark, sf_dir) -> DataFrame:
    pairs = V.doc_pairs(spark, sf_dir)
    stored = [
        materialize(sketches.delivery_sketches(pairs.filter(F.col("ord") % 4 == k)), "delivery") for k in range(4)
    ]
    return sketches.merged_sketches(reduce(DataFrame.unionByName, stored), "side")


@query
def term_hits(spark, sf_dir):
    """How many of the two-word sequences of the benchmark stand in each document."""
    benchmark = tables.scan_table(spark, f"{sf_dir}/benchmark.parquet", "item_id long, text string")
    words = benchmark.select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    pairs = F.explode(F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.array(x, F.get("w", i + 1))))
    found = words.filter(F.size("w") > 1).select(pairs.alias("parts")).distinct()
    listed = found.select(F.array_join("parts", " ").alias("term"), "parts")
    hits = terms.term_hits(V.documents(spark, sf_dir), listed)
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_terms"))


@query
def word_vocab_size(spark, sf_dir):
    return profile.word_vocab_size(V.doc_pairs(spark, sf_dir))


# Split


@query
def stratified_split(spark, sf_dir):
    return split.stratified_split(V.category_pairs(spark, sf_dir))


@query
def skipped_categories(spark, sf_dir):
    return split.skipped_categories(V.category_pairs(spark, sf_dir))


@query
def category_report(spark, sf_dir):
    return split.category_report(V.category_pairs(spark, sf_dir))


@query
def split_report(spark, sf_dir):
    return split.split_report(V.category_pairs(spark, sf_dir))


@query
def split_leakage(spark, sf_dir):
    splits = materialize(split.stratified_split(V.category_pairs(spark, sf_dir)), "splits")
    return split.split_leakage(splits)


@query
def leak_report(spark, sf_dir):
    """Validation and test rows that occur in the train split or in the training feed."""
    splits = materialize(split.stratified_split(V.category_pairs(spark, sf_dir)), "splits")
    corpora = {"train": splits.filter("split = 'train'"), "feed": _feed_sources(spark, sf_dir)}
    return split.leak_report(splits, corpora)


# Mix and batches


def _sources(spark, sf_dir, *columns: str) -> DataFrame:
    named = {"field": V.chat_pairs(spark, sf_dir), "base": V.doc_pairs(spark, sf_dir)}
    return mix.stack_sources(named, ["ord", *columns])


@query
def weighted_mix(spark, sf_dir):
    return mix.weighted_mix(_sources(spark, sf_dir, "src", "tgt"), WEIGHTS)


@query
def mix_report(spark, sf_dir):
    return mix.mix_report(_sources(spark, sf_dir), WEIGHTS)


@query
def shuffled_mix(spark, sf_dir):
    return mix.shuffled_mix(mix.weighted_mix(_sources(spark, sf_dir), WEIGHTS), SEED)


@query
def batch_assign(spark, sf_dir):
    mixed = mix.weighted_mix(_sources(spark, sf_dir), WEIGHTS)
    return mix.assign_batches(mixed, TRAIN_BATCH, seed=SEED)


@query
def batch_assign_ordered(spark, sf_dir):
    pairs = V.doc_pairs(spark, sf_dir).select("ord")
    return mix.assign_batches(pairs, VAL_BATCH, order="ord", drop_last=False)


# Subword vocabulary


@query
def word_freq(spark, sf_dir):
    return _words(spark, sf_dir)


@query
def char_coverage(spark, sf_dir):
    return subword.char_coverage(_words(spark, sf_dir))


@query
def bpe_pair_counts(spark, sf_dir):
    vocab_words = materialize(_words(spark, sf_dir), "words")
    kept = subword.char_coverage(vocab_words).filter("kept").select("char")
    alphabet = [r.char for r in kept.collect()]
    alphabet = sorted({*alphabet, *subword.PROTECTED})
    return subword.pair_counts(subword.segment_chars(vocab_words, alphabet))


@query
def learn_bpe(spark, sf_dir):
    """Learned anew at every call, and kept for the other queries."""
    learned = subword.learn_bpe(_words(spark, sf_dir), VOCAB)
    learned.save(spark, _model_path(spark, sf_dir))
    return learned.merges_frame(spark)


@query
def bpe_vocab(spark, sf_dir):
    return model(spark, sf_dir).vocab_frame(spark)


@query
def vocab_report(spark, sf_dir):
    return subword.vocab_report(model(spark, sf_dir), _words(spark, sf_dir))


def _encoded(spark, sf_dir) -> DataFrame:
    return encoding.encode_pairs(V.doc_pairs(spark, sf_dir), model(spark, sf_dir))


@query
def encode_pairs(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "ord", _joined("src_ids").alias("src_ids"), _joined("tgt_ids").alias("tgt_ids")
    )


@query
def unk_rate(spark, sf_dir):
    return encoding.unk_rate(_encoded(spark, sf_dir))


@query
def decode_pieces(spark, sf_dir):
    vocab = model(spark, sf_dir).vocab_frame(spark)
    decoded = encoding.decode_pieces(_encoded(spark, sf_dir), vocab, "src_ids", "src_pieces")
    decoded = encoding.decode_pieces(decoded, vocab, "tgt_ids", "tgt_pieces")
    return decoded.select("ord", _joined("src_pieces").alias("src_pieces"), _joined("tgt_pieces").alias("tgt_pieces"))


@query
def decode_text(spark, sf_dir):
    vocab = model(spark, sf_dir).vocab_frame(spark)
    decoded = encoding.decode_text(_encoded(spark, sf_dir), vocab, "src_ids", "src_text")
    return encoding.decode_text(decoded, vocab, "tgt_ids", "tgt_text").select("ord", "src_text", "tgt_text")


@query
def shared_pieces(spark, sf_dir):
    vocab = model(spark, sf_dir).vocab_frame(spark)
    shared = encoding.shared_pieces(_encoded(spark, sf_dir), vocab)
    return shared.select("ord", _joined("shared_ids").alias("shared_ids"), _joined("shared").alias("shared"))


def _packed(pairs: DataFrame, learned: subword.SubwordModel, *keys: str) -> DataFrame:
    return encoding.encode_pairs(pairs, learned).select(
        *keys, Q.pack(F.col("src_ids")).alias("src_ids"), Q.pack(F.col("tgt_ids")).alias("tgt_ids")
    )


def _feed_sources(spark, sf_dir) -> DataFrame:
    """The train split, and the clean corpus without any pair that is held out."""
    splits = materialize(split.stratified_split(V.category_pairs(spark, sf_dir)), "splits")
    key = clean.pair_key(F.lower("src"), F.lower("tgt")).alias("_key")
    held_out = splits.filter("split <> 'train'").select(key)
    corpus = clean.clean_pairs(V.doc_pairs(spark, sf_dir)).select("*", key)
    named = {"field": splits.filter("split = 'train'"), "base": corpus.join(held_out, "_key", "left_anti")}
    return mix.stack_sources(named, ["ord", "src", "tgt"])


@query
def finetune_feed(spark, sf_dir):
    """Encode, pack, then mix, shuffle and batch: texts are encoded before they are repeated."""
    learned = model(spark, sf_dir)
    packed = materialize(_packed(_feed_sources(spark, sf_dir), learned, "source", "ord"), "packed")
    feed = mix.assign_batches(mix.weighted_mix(packed.select("source", "ord"), WEIGHTS), VAL_BATCH, seed=SEED)
    return feed.join(packed, ["source", "ord"]).select(
        "batch_id", "pos", "source", "ord", "copy",
        _joined("src_ids").alias("src_ids"), _joined("tgt_ids").alias("tgt_ids"),
    )


@query
def write_feed(spark, sf_dir):
    """The training feed written by batch, and read back."""
    path = scratch_path(spark, "feed")
    feed = finetune_feed(spark, sf_dir)
    sinks.write_feed(feed, path)
    return spark.read.schema(feed.schema).parquet(path)


@query
def feed_report(spark, sf_dir):
    """Samples, steps and the effective batch of the feeds."""
    mixed = mix.weighted_mix(_feed_sources(spark, sf_dir).select("source", "ord"), WEIGHTS)
    val = split.split_positions(V.category_pairs(spark, sf_dir)).filter("split = 'val'")
    return mix.feed_report(mixed, val, VAL_BATCH, ACCUMULATE, EPOCHS)


@query
def validation_feed(spark, sf_dir):
    """The validation split in its own order; the last batch stays, whatever its size."""
    splits = split.stratified_split(V.category_pairs(spark, sf_dir)).filter("split = 'val'")
    packed = materialize(_packed(splits, model(spark, sf_dir), "ord"), "packed")
    feed = mix.assign_batches(packed, VAL_BATCH, order="ord", drop_last=False)
    return feed.select("batch_id", "pos", "ord", _joined("src_ids").alias("src_ids"), _joined("tgt_ids").alias("tgt_ids"))


# Loss logs and provenance


@query
def epoch_loss(spark, sf_dir):
    rounded = F.round("avg_loss", 6).alias("avg_loss")
    return losses.epoch_loss(V.loss_log(spark, sf_dir)).select("run", "epoch", rounded, "n_batches")


@query
def val_loss(spark, sf_dir):
    rounded = F.round("avg_val_loss", 6).alias("avg_val_loss")
    return losses.val_loss(V.loss_log(spark, sf_dir)).select("run", "epoch", rounded, "n_batches")


@query
def running_loss(spark, sf_dir):
    reports = losses.running_loss(V.loss_log(spark, sf_dir), REPORT_EVERY)
    return reports.withColumn("running_avg", F.round("running_avg", 6))


@query
def best_checkpoint(spark, sf_dir):
    """Best epochs by a loss rounded to whole units, which makes ties: the first by training loss, the last by validation loss."""
    log = V.loss_log(spark, sf_dir)
    trained = losses.epoch_loss(log).withColumn("loss", F.round(F.round("avg_loss", 6)))
    validated = losses.val_loss(log).withColumn("loss", F.round(F.round("avg_val_loss", 6)))
    first = losses.best_checkpoint(trained, "loss")
    last = losses.best_checkpoint(validated, "loss", keep_last_tie=True)
    return first.select("run", F.col("best_epoch").alias("first_epoch"), "best_loss").join(
        last.select("run", F.col("best_epoch").alias("last_epoch"), F.col("best_loss").alias("best_val_loss")), "run"
    )


@query
def latest_checkpoint(spark, sf_dir):
    return losses.latest_checkpoint(V.loss_log(spark, sf_dir), 20)


@query
def provenance_rollup(spark, sf_dir):
    return provenance.provenance_rollup(V.doc_pairs(spark, sf_dir))


@query
def consent_filter(spark, sf_dir):
    pairs = V.doc_pairs(spark, sf_dir).withColumnRenamed("source", "session_id")
    kept = provenance.consent_filter(pairs, V.sessions(spark, sf_dir))
    return kept.select("session_id", "ord", "category", "src", "tgt")


# BLEU


def _segments(spark, sf_dir) -> DataFrame:
    return bleu.pair_segments(V.hypotheses(spark, sf_dir), V.references(spark, sf_dir))


@query
def bleu_tokenize(spark, sf_dir):
    tokens = _joined(bleu.bleu_tokenize(F.col("text")))
    return V.documents(spark, sf_dir).select("doc_id", tokens.alias("tokens"))


@query
def ngram_counts(spark, sf_dir):
    """Counts over all documents, summed by segment and order."""
    return bleu.ngram_counts(_segments(spark, sf_dir)).groupBy("seg_id", "n").agg(
        F.count("*").alias("n_grams"), F.sum("hyp_count").alias("hyp_count"), F.sum("ref_count").alias("ref_count"),
        F.max("ref_count").alias("most"),
    )


@query
def clipped_matches(spark, sf_dir):
    return bleu.clipped_matches(_segments(spark, sf_dir))


@query
def bleu_corpus(spark, sf_dir):
    scored = bleu.bleu_corpus(_segments(spark, sf_dir))
    return scored.withColumns(
        {"bleu": F.round("bleu", 6), "brevity_penalty": F.round("brevity_penalty", 6)}
    )


@query
def eval_table(spark, sf_dir):
    return bleu.eval_table(_segments(spark, sf_dir))
