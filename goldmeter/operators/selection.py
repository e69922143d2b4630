"""Ranked selection among candidate events, with a decision log.

The winner per (document, field) is a max over rank structs, so partial aggregation
shrinks hot groups before the shuffle; the log joins winners back to the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions import vocabulary as V
from goldmeter.functions.text import any_of, computed_once, norm_value, text_of


def select_ranked(candidates: DataFrame, keys: list[str], ranks: list[str], order: str) -> DataFrame:
    """Best selectable candidate per key: highest rank tuple; the earliest wins ties.

    Only candidates whose first rank is positive can win.
    """
    rest = [c for c in candidates.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*[F.col(r) for r in ranks], (-F.col(order)).alias("_o")))
    return candidates.filter(F.col(ranks[0]) > 0).groupBy(*keys).agg(top.alias("_w")).select(*keys, "_w.*")


def selection_log(candidates: DataFrame, keys: list[str], ranks: list[str], order: str, event_id: str = "id") -> DataFrame:
    """Every candidate with its decision: selected / discarded / conflict (selectable but outranked)."""
    winners = select_ranked(candidates, keys, ranks, order).select(*keys, F.col(event_id).alias("selected_id"))
    joined = candidates.join(winners, keys, "left")
    decision = (
        F.when(F.col(event_id) == F.col("selected_id"), "selected")
        .when(F.col("selected_id").isNull(), "missing").when(F.col(ranks[0]) > 0, "conflict").otherwise("discarded")
    )
    return joined.withColumn("decision", decision)


def missing_fields(candidates: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that had candidates but no selectable one."""
    return candidates.select(*keys).distinct().join(winners.select(*keys), keys, "left_anti")


# ---- ranks of clinical events -----------------------------------------------------------


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def event_position(events: DataFrame) -> DataFrame:
    """Index inside the event's own list, and the position key (quote offset, else the index).

    Medications, frequencies, investigations (per type) and diagnoses count inside their
    category; seizure types count over all events of the document.
    """
    by = W.partitionBy("document_id", "category", F.when(F.col("category") == "investigation", F.col("investigation_type"))).orderBy("event_idx")
    inside = F.when(F.col("category") == "seizure_type", F.col("event_idx")).otherwise(F.row_number().over(by) - 1)
    return events.withColumn("list_idx", inside).withColumn("position", F.coalesce(F.col("evidence.char_start"), F.col("list_idx")))


def ranked_events(events: DataFrame) -> DataFrame:
    """Candidates with field name and rank tuple (r0, r1, r2, r3); unused ranks repeat the position."""
    e = event_position(events)
    cat, temp, status, pos = F.col("category"), F.col("temporality"), F.col("status"), F.col("position")
    name = N.medication_name(F.coalesce(F.nullif(F.col("medication_name"), F.lit("")), F.col("value")))
    has_parts = (text_of(F.col("dose")) != "") | (text_of(F.col("dose_unit")) != "") | (text_of(F.col("frequency")) != "")
    # bound in a generator: a later filter on a field or a rank would repeat both trees at every mention
    e = computed_once(
        e, e.columns,
        canonical=F.when(cat == "medication", name).when(cat == "seizure_type", N.seizure_type(F.col("value")))
        .when(cat == "diagnosis", N.diagnosis(F.col("value")))
        .when(cat == "investigation", N.investigation_result(F.coalesce(F.nullif(F.col("result"), F.lit("")), F.col("value"))))
        .otherwise(norm_value(F.col("value"))),
        said=norm_value(F.col("value")))
    canon, said = F.col("canonical"), F.col("said")
    field = (
        F.when(cat == "medication", F.concat(F.lit("current_anti_seizure_medications["), F.when(canon == "", F.concat(F.lit("__unnamed_"), F.col("list_idx").cast("string"))).otherwise(canon), F.lit("]")))
        .when(cat == "seizure_frequency", "current_seizure_frequency")
        .when(cat == "seizure_type", F.concat(F.lit("seizure_types["), canon, F.lit("]")))
        .when((cat == "investigation") & F.col("investigation_type").isin("EEG", "MRI"), F.lower("investigation_type"))
        .when(cat == "diagnosis", "epilepsy_diagnosis")
    )
    mapped = ((canon != "") & (canon != said)) | canon.isin(V.RANKED_SEIZURE_TYPES)
    active_med = (temp == "current") & status.isin("current", "increased", "reduced")
    not_past = ~F.coalesce(temp.isin("historical", "family_history", "hypothetical", "planned"), F.lit(False))
    done = (status == "completed") & canon.isin("normal", "abnormal", "uncertain")
    patient = ~F.coalesce(temp == "family_history", F.lit(False))

    def by_category(med, freq, typ, inv, dx):
        return (F.when(cat == "medication", med).when(cat == "seizure_frequency", freq).when(cat == "seizure_type", typ)
                .when(cat == "investigation", inv).when(cat == "diagnosis", dx))

    out = e.withColumn("field", field).filter(F.col("field").isNotNull())
    return out.withColumn("r0", by_category(
        _flag(active_med), _flag((temp == "current") | not_past), _flag(mapped | any_of(said, V.EXPLICIT_SEIZURE_WORDS)),
        _flag(done), _flag(patient & N.is_epilepsy_diagnosis(canon)))
    ).withColumn("r1", by_category(
        _flag(status == "current"), _flag(temp == "current"), _flag(mapped), _flag(canon.isin("normal", "abnormal")), _flag(temp == "current"))
    ).withColumn("r2", by_category(
        _flag(has_parts), _flag(text_of(F.col("seizure_type")) != ""), F.lit(0), _flag(status == "completed"), F.lit(0))
    ).withColumn("r3", F.when(cat == "seizure_type", -F.col("event_idx")).otherwise(pos)).drop("said")


RANKS = ["r0", "r1", "r2", "r3"]


def aggregate_events(events: DataFrame) -> DataFrame:
    """Selected event per (document_id, field).

    Seizure types keep the first event of each canonical type, so their last rank prefers
    early events and their second rank is neutral for the choice.
    """
    ranked = ranked_events(events)
    typ = F.col("category") == "seizure_type"
    ranked = ranked.withColumn("r1", F.when(typ, 0).otherwise(F.col("r1")))
    return select_ranked(ranked, ["document_id", "field"], RANKS, "event_idx")


def event_log(events: DataFrame) -> DataFrame:
    ranked = ranked_events(events)
    typ = F.col("category") == "seizure_type"
    ranked = ranked.withColumn("r1", F.when(typ, 0).otherwise(F.col("r1")))
    log = selection_log(ranked, ["document_id", "field"], RANKS, "event_idx")
    cat, temp, status = F.col("category"), F.col("temporality"), F.col("status")
    reason = (
        F.when(F.col("decision") == "selected", "selected")
        .when((cat == "medication") & (F.col("r0") == 0) & ((temp == "historical") | status.isin("previous", "stopped")),
              "non-current medication retained only in previous medication extension")
        .when((cat == "medication") & (F.col("r0") == 0) & ((temp == "planned") | status.isin("planned", "declined")),
              "planned or declined medication is not a current ASM")
        .when((cat == "medication") & (F.col("r0") == 0) & ~F.coalesce(status == "current", F.lit(False)),
              "medication status is not explicitly current")
        .when((cat == "seizure_type") & (F.col("r0") == 0), "unmapped descriptive semiology is not promoted to seizure type")
        .when(cat == "seizure_type", "duplicate canonical seizure type")
        .when(F.col("decision") == "conflict", "ranked candidate selected over lower-ranked candidate")
        .otherwise("not selectable")
    )
    return log.select("document_id", "field", "id", "category", "event_idx", *RANKS, "decision", reason.alias("reason"))


def previous_medications(events: DataFrame) -> DataFrame:
    """Historical, previous or stopped medications, as the non-current extension."""
    past = F.col("status").isin("previous", "stopped") | (F.col("temporality") == "historical")
    status = F.when(F.col("status").isin("previous", "stopped"), F.col("status")).otherwise("previous")
    return events.filter((F.col("category") == "medication") & F.coalesce(past, F.lit(False))).select(
        "document_id", "event_idx", "id",
        F.coalesce(F.nullif(F.col("medication_name"), F.lit("")), F.col("value")).alias("name"), status.alias("status"),
        F.lit("historical").alias("temporality"))


# ---- first-seen, latest, top-k, sampling ------------------------------------------------


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of every key in order; an aggregate, so copies shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, "_f.*")


def latest_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of every key in ingest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*keys, "_l.*")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key; Spark limits each partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hash_number(*parts: Column) -> Column:
    """Uniform 32-bit number of a key, equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def stratified_draw(rows: DataFrame, stratum: str, targets: dict[str, int], id_column: str, seed: int = 42) -> DataFrame:
    """At most `targets[s]` rows of each stratum in seeded hash order."""
    n = F.create_map(*[F.lit(v) for p in targets.items() for v in p])
    order = [hash_number(F.lit(str(seed)), F.col(id_column).cast("string")), F.col(id_column)]
    # strata outside the targets have no quota; the overall maximum lets Spark pre-limit each partition
    drawn = top_k(rows.filter(F.col(stratum).isin(list(targets))), [stratum], order, max(targets.values()))
    return drawn.filter(F.col("rank") <= F.try_element_at(n, F.col(stratum))).drop("rank")


def top_up(rows: DataFrame, drawn: DataFrame, id_column: str, size: int, seed: int = 42) -> DataFrame:
    """The draw, filled to `size` rows from the remainder in hash order."""
    rest = rows.join(drawn.select(id_column), id_column, "left_anti")
    have = drawn.agg(F.count(F.lit(1)).alias("_have")).withColumn("_one", F.lit(1))
    order = hash_number(F.lit(str(seed + 1)), F.col(id_column).cast("string"))
    limited = rest.withColumn("_h", order).orderBy("_h", id_column).limit(size)
    numbered = limited.withColumn("_n", F.row_number().over(W.orderBy("_h", id_column)))
    extra = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(have), "_one").filter(F.col("_n") <= size - F.col("_have"))
    return drawn.unionByName(extra.select(*drawn.columns))


def fixed_splits(ids: DataFrame, salt: str = V.SPLIT_SALT, shares=(("development", 0.6), ("validation", 0.2), ("test", 0.2)),
                 id_column: str = "document_id") -> DataFrame:
    """Deterministic splits by position in salted SHA-256 order, without a global sort.

    Ids are cut into 4,096 hash buckets; bucket sizes (a table of at most 4,096 rows) give
    each bucket its offset, and only inside a bucket are ids numbered.
    """
    hashed = ids.select(id_column, F.sha2(F.concat(F.lit(salt + ":"), F.col(id_column).cast("string")), 256).alias("_h")).withColumn(
        "_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 4,096 rows by construction of the bucket number, so one ordered pass is bounded
    order = W.partitionBy(F.lit(0)).orderBy("_b")
    running = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = sizes.select("_b", (running - F.col("_n")).alias("_start"), total.alias("_total"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", id_column)) - 1
    placed = hashed.withColumn("_i", inside).join(F.broadcast(offsets), "_b").withColumn("pos", F.col("_start") + F.col("_i"))
    edge, named = 0.0, F.lit(None).cast("string")
    bounds = []
    for name, share in shares:
        edge += share
        bounds.append((name, edge))
    named = F.lit(bounds[-1][0])
    for name, upper in reversed(bounds[:-1]):
        named = F.when(F.col("pos") < F.round(F.col("_total") * F.lit(upper)), name).otherwise(named)
    return placed.select(id_column, named.alias("split"), "pos")


def documents_of(documents: DataFrame, splits: DataFrame, split: str, id_column: str = "document_id") -> DataFrame:
    """Documents of one split, by semi join."""
    return documents.join(splits.filter(F.col("split") == split).select(id_column), id_column, "left_semi")


def unknown_ids(wanted: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    """Requested ids that do not exist; a non-empty result is an error of the request."""
    return wanted.join(known.select(id_column), id_column, "left_anti")


def sequential_ids(rows: DataFrame, keys: list[str], order: list[Column], pattern: str = "s%04d") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("seq_id", F.format_string(pattern, F.row_number().over(w)))


# ---- gold to events, loose event lists --------------------------------------------------


def gold_events(gold: dict[str, DataFrame]) -> DataFrame:
    """Synthetic event list of the gold tables: the oracle input of the aggregation.

    The i-th item of a group takes the i-th span of the group, or its last one.
    """
    spans = gold["spans"].filter(F.col("group").isin("medications", "seizure_frequency", "diagnosis", "eeg", "mri"))
    # the spans of a document's group are few and stand in one row, so they are told once and met in one join
    listed = spans.groupBy("document_id", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "value"))).alias("spans"))

    def number(df):
        return df.withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("ord")).cast("int"))

    def rows(df, group, category, idx_base, **cols):
        out = {"status": F.lit(None).cast("string"), "medication_name": F.lit(None).cast("string"), "dose": F.lit(None).cast("string"),
               "dose_unit": F.lit(None).cast("string"), "frequency": F.lit(None).cast("string"),
               "investigation_type": F.lit(None).cast("string"), "result": F.lit(None).cast("string"),
               "temporal_scope": F.lit(None).cast("string"), "seizure_type": F.lit(None).cast("string"), "temporality": F.lit("current")}
        out.update(cols)
        return df.select("document_id", F.lit(group).alias("group"), F.col("n"), F.lit(idx_base).alias("base"),
                         F.lit(category).alias("category"), *[c.alias(k) for k, c in out.items()])

    meds = rows(number(gold["medications"]).filter(text_of(F.col("name")) != ""), "medications", "medication", 0,
                id=F.concat(F.lit("gold_med_"), F.col("n").cast("string")), value=F.col("name"), status=F.lit("current"),
                medication_name=F.col("name"), dose=F.nullif(F.col("dose"), F.lit("")), dose_unit=F.nullif(F.col("dose_unit"), F.lit("")),
                frequency=F.nullif(F.col("frequency"), F.lit("")))
    fq = number(gold["frequencies"]).filter(text_of(F.col("value")) != "")
    scope = F.when(text_of(F.col("temporal_scope")) != "", F.col("temporal_scope")).otherwise("current")
    freqs = rows(fq, "seizure_frequency", "seizure_frequency", 1, id=F.concat(F.lit("gold_freq_"), F.col("n").cast("string")),
                 value=F.col("value"), temporal_scope=scope, seizure_type=F.nullif(F.col("seizure_type"), F.lit("")))
    types = rows(fq.filter(text_of(F.col("seizure_type")) != ""), "seizure_frequency", "seizure_type", 2,
                 id=F.concat(F.lit("gold_type_from_freq_"), F.col("n").cast("string")), value=F.col("seizure_type"))
    dxs = rows(number(gold["diagnoses"]), "diagnosis", "diagnosis", 3, id=F.concat(F.lit("gold_dx_"), F.col("n").cast("string")),
               value=F.col("label"))
    both = gold["investigations"].select("document_id", F.explode(F.array(
        F.struct(F.lit("eeg").alias("kind"), F.col("eeg").alias("res")), F.struct(F.lit("mri").alias("kind"), F.col("mri").alias("res")))).alias("x")
    ).select("document_id", "x.kind", "x.res", F.lit(1).alias("n")).filter(text_of(F.col("res")) != "")
    invs = both.select(
        "document_id", F.col("kind").alias("group"), "n", F.lit(4).alias("base"), F.lit("investigation").alias("category"),
        *[c.alias(k) for k, c in {
            "status": F.lit("completed"), "medication_name": F.lit(None).cast("string"), "dose": F.lit(None).cast("string"),
            "dose_unit": F.lit(None).cast("string"), "frequency": F.lit(None).cast("string"), "investigation_type": F.upper("kind"),
            "result": F.col("res"), "temporal_scope": F.lit(None).cast("string"), "seizure_type": F.lit(None).cast("string"),
            "temporality": F.lit("completed"), "id": F.concat(F.lit("gold_"), F.col("kind")), "value": F.col("res")}.items()])
    events = meds.unionByName(freqs).unionByName(types).unionByName(dxs).unionByName(invs)
    own = F.get("spans", F.least("n", F.size("spans")) - 1)
    placed = events.join(listed, ["document_id", "group"], "left").withColumn("own", own).withColumns(
        {"start": F.col("own.start"), "end": F.col("own.end"), "span_value": F.col("own.value")})
    evidence = F.struct(
        F.coalesce(F.nullif(F.col("span_value"), F.lit("")), F.col("value")).alias("quote"), F.lit(None).cast("string").alias("sentence_id"),
        F.col("start").alias("char_start"), F.col("end").alias("char_end"))
    idx = F.row_number().over(W.partitionBy("document_id").orderBy("base", "n", "id")) - 1
    return placed.withColumn("event_idx", idx).withColumn("evidence", evidence).drop("group", "n", "base", "spans", "own", "start", "end", "span_value")


def loose_event_payload(events: DataFrame) -> DataFrame:
    """Simple event rows (document_id, ord, type, value, name, current, ...) to one payload per document.

    Current medications and types are kept once per canonical name in first-seen order; the
    first frequency and diagnosis count. Investigations, doses, units and medication frequencies are not taken over.
    """
    t, v = F.col("type"), F.trim(text_of(F.col("value")))
    name = F.trim(text_of(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("value"))))
    live = F.coalesce(F.col("current"), F.lit(True))
    canon = F.when((t == "medication") & live, N.medication_name(name)).when((t == "seizure_type") & live, N.seizure_type(v))
    item = F.when((t == "medication") & live & (name != ""), F.coalesce(F.nullif(canon, F.lit("")), name)).when(
        (t == "seizure_type") & live & (v != ""), F.coalesce(F.nullif(canon, F.lit("")), v))
    kept = first_seen(
        events.withColumn("item", item).filter(F.col("item").isNotNull()).select("document_id", "type", "item", "ord"),
        ["document_id", "type", "item"], "ord")
    # distinct canonical items per document: bounded by the vocabulary plus unmapped names of that document
    lists = kept.groupBy("document_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("ord", "item")))), lambda x: x["item"]).alias(n)
        for k, n in (("medication", "medication_names"), ("seizure_type", "seizure_types"))])
    firsts = events.filter(v != "").groupBy("document_id").agg(*[
        F.min_by(F.when(t == k, v), F.when(t == k, F.col("ord"))).alias(n)
        for k, n in (("seizure_frequency", "seizure_frequency"), ("diagnosis", "epilepsy_diagnosis_type"))])
    return events.select("document_id").distinct().join(lists, "document_id", "left").join(firsts, "document_id", "left")


def compact_event_payload(events: DataFrame) -> DataFrame:
    """Compact event rows (document_id, ord, type, name, value, current, dose, unit, frequency, modality, result) to one payload per document.

    Current medications (with dose, unit and frequency of their first mention) and seizure types are kept once per canonical name in
    first-seen order; a null `current` means current. The first stated frequency and diagnosis count, and the first result of EEG and
    of MRI even where it is empty. Empty doses stay, empty units and frequencies are null. `payload` is the same as JSON text.
    A document without a usable event has empty lists and nulls; of rows with one ord the smaller ones count.
    """
    t, live = F.col("type"), F.coalesce(F.col("current"), F.lit(True))
    name, value = F.trim(text_of(F.col("name"))), F.trim(text_of(F.col("value")))

    def stated(c: str) -> Column:
        return F.nullif(text_of(F.col(c)), F.lit(""))

    canon = F.coalesce(F.nullif(F.when(t == "medication", N.medication_name(name)).otherwise(N.seizure_type(value)), F.lit("")),
                       F.when(t == "medication", name).otherwise(value))
    modality = F.upper(text_of(F.col("modality")))
    item = (
        F.when((t == "medication") & live & (name != ""), canon).when((t == "seizure_type") & live & (value != ""), canon)
        .when(t.isin("seizure_frequency", "diagnosis") & (value != ""), "").when((t == "investigation") & modality.isin("EEG", "MRI"), modality))
    # one row per document, kind and name first, so a hot document is many groups; what is left of it is bounded by its distinct names
    said = events.select("document_id", "ord", "type", item.alias("item"), F.col("dose").cast("string").alias("dose"), stated("unit").alias("unit"),
                         stated("frequency").alias("frequency"), F.when(t == "investigation", F.lower(text_of(F.col("result")))).otherwise(value).alias("said"))
    rest = F.struct("ord", "dose", "unit", "frequency", "said")
    firsts = said.groupBy("document_id", "type", "item").agg(F.min(rest).alias("f"))
    kept = F.col("item").isNotNull()

    def listed(kind: str, made) -> Column:
        rows = F.array_sort(F.collect_list(F.when(kept & (t == kind), F.struct("f.ord", "item", "f.dose", "f.unit", "f.frequency"))))
        return F.transform(rows, made)

    def one(kind: str, which: str = "") -> Column:
        return F.max(F.when((t == kind) & (F.col("item") == which), F.col("f.said")))

    out = firsts.groupBy("document_id").agg(
        listed("medication", lambda x: F.struct(x["item"].alias("name"), x["dose"].alias("dose"), x["unit"].alias("unit"), x["frequency"].alias("frequency"))).alias("medications"),
        listed("seizure_type", lambda x: x["item"]).alias("seizure_types"), one("seizure_frequency").alias("seizure_frequency"),
        one("diagnosis").alias("epilepsy_diagnosis_type"), one("investigation", "EEG").alias("eeg"), one("investigation", "MRI").alias("mri"))
    fields = [F.col(c) for c in out.columns if c != "document_id"]
    names = F.transform("medications", lambda m: m["name"]).alias("medication_names")
    return out.withColumn("payload", F.to_json(F.struct(*fields, names, F.struct("eeg", "mri").alias("investigations"))))
