"""P1. The whole run: load, triage, leads, verdicts, persist, report, archive."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope import schema
from folioscope.operators import (cycles, detectors, evidence, integrity, leads, materiality,
                                  report, thresholds, views)
from folioscope.session import release, settle, tune
from folioscope.settings import Settings
from folioscope.sources import (archive, canonical, documents, drafts, foreign, staging,
                                warehouse)


@dataclass
class Findings:
    """Everything one run derives from the books, as tables."""

    thresholds: tuple
    cycles: cycles.CycleSearch
    candidates: DataFrame
    leads: DataFrame
    evidence: DataFrame
    verdicts: DataFrame


def investigate(entities: DataFrame, blacklist: DataFrame, invoices: DataFrame, items: DataFrame,
                ledger: DataFrame, catalog: DataFrame, settings: Settings = Settings(),
                rfcs: DataFrame | None = None) -> Findings:
    """From books to verdicts, for every candidate or for the given IDs.

    Half paths are grown once, at the proof's low minimum leg; the detector's cycles
    are those whose smallest leg also passes its threshold. None of them is listed.
    """
    cycle_floor, income_floor = thresholds.amount_thresholds(ledger, settings)
    proof_cycles = cycles.CycleSearch(
        views.money_network(cycles.between_payers(ledger)), settings.proof_min_leg,
        settings.max_cycle_nodes, settings.max_leg_ratio, settings.min_cycle_nodes)
    big_cycles = proof_cycles.at_least(cycle_floor)
    nominated = rfcs if rfcs is not None else detectors.candidates(
        invoices, items, ledger, blacklist, big_cycles, income_floor, settings)
    immaterial = settle(materiality.immaterial_invoices(
        invoices, items, catalog, entities, settings))
    proving = settle(leads.scheme_evidence(
        invoices, ledger, blacklist, big_cycles, immaterial, income_floor))
    # The leads and their evidence both start from the candidates.
    proposed, cited = leads.propose_leads(settle(nominated.select("rfc")), proving)
    resolved = evidence.keep_resolved(evidence.resolve_evidence(cited, invoices, ledger))
    marked = evidence.mark_proofs(resolved, blacklist, immaterial, income_floor)
    decided = settle(evidence.verdicts(
        proposed, marked, entities, cycles.cycle_members(proof_cycles), income_floor))
    return Findings((cycle_floor, income_floor), proof_cycles, nominated, proposed, resolved,
                    decided)


def judge_drafts(texts: DataFrame, seen: DataFrame, entities: DataFrame, blacklist: DataFrame,
                 invoices: DataFrame, items: DataFrame, ledger: DataFrame, catalog: DataFrame,
                 settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """S21, E10, E3. (verdicts, resolved evidence) of leads that others wrote as text.

    `texts` has lead_id, rfc and text; `seen.id` are the identifiers their author was shown.
    """
    _, income_floor = thresholds.amount_thresholds(ledger, settings)
    proposed, cited = leads.drop_unseen(
        *evidence.flat_leads(settle(drafts.parse_drafts(texts))), seen)
    resolved = evidence.keep_resolved(evidence.resolve_evidence(cited, invoices, ledger))
    immaterial = settle(materiality.immaterial_invoices(
        invoices, items, catalog, entities, settings))
    search = cycles.CycleSearch(
        views.money_network(cycles.between_payers(ledger)), settings.proof_min_leg,
        settings.max_cycle_nodes, settings.max_leg_ratio, settings.min_cycle_nodes)
    marked = evidence.mark_proofs(resolved, blacklist, immaterial, income_floor)
    return settle(evidence.verdicts(proposed, marked, entities, search.members(),
                                    income_floor)), resolved


def read_input(spark: SparkSession, folder: str | None,
               texts: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """S20. The five tables as text, from a folder of tables, from documents, or from both.

    `texts` has doc_id and text. Tables that documents alone do not give are empty.
    """
    tables, report = {}, spark.createDataFrame([], foreign.REPORT)
    if folder is not None:
        tables, report = foreign.canonical_input(spark, staging.read_folder(spark, folder))
    if texts is None:
        return staging.require_tables(tables), report
    sheets, notes = documents.canonical_sheets(texts)
    for sheet, columns in fv.REQUIRED_COLUMNS.items():
        parts = [t[sheet] for t in (tables, sheets) if sheet in t]
        parts = parts or [spark.createDataFrame(
            [], ", ".join(f"{c} string" for c in columns) + ", _row long")]
        for part in parts:
            staging.require_columns(part, sheet)
        tables[sheet] = reduce(DataFrame.unionByName, [p.select(*columns, "_row") for p in parts])
    return staging.require_tables(tables), report.unionByName(notes.select(
        F.lit(None).cast("int").alias("orden"), F.lit(None).cast("string").alias("tabla"), "nota",
        F.col("documento").alias("origen"), F.col("valor").alias("destino")))


def load(spark: SparkSession, folder: str | None, store: warehouse.Warehouse,
         texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Read, type, check and store tables and documents. Returns (counts, translation report).

    Each raw table is read once, whatever format it had. Its text, and then its current
    rows, are kept in the shared folder and checked from there, so no check reads or
    shuffles the input again. Any violation rejects the load before anything is written
    to the store; the error holds the violations table.
    """
    tables, translation = read_input(spark, folder, texts)
    tables = {s: settle(raw) for s, raw in tables.items()}
    typed, faults = {}, spark.createDataFrame([], canonical.VIOLATION)
    for sheet, raw in tables.items():
        typed[sheet], found = canonical.typed_table(sheet, raw)
        faults = faults.unionByName(found)
    reject_if_any(faults)
    current = {
        schema.TABLE_OF_SHEET[s]: settle(canonical.last_row_wins(df, canonical.KEYS[s])
                                         if s in canonical.KEYS else df)
        for s, df in typed.items() if s != "Lista_69B"}
    reject_if_any(integrity.reference_violations(current))
    with store.reading() as version:
        current["blacklist_69b"] = canonical.merged_blacklist(
            store.table("blacklist_69b", version), typed["Lista_69B"])
        store.replace(current)
    return settle(canonical.load_counts(
        {schema.TABLE_OF_SHEET[s]: df for s, df in typed.items()})), translation


class RejectedLoad(staging.LoadError):
    def __init__(self, violations: DataFrame, example):
        super().__init__(f"carga rechazada, por ejemplo: {example.asDict()}")
        self.violations = violations


def reject_if_any(violations: DataFrame) -> None:
    example = violations.limit(1).collect()
    if example:
        raise RejectedLoad(violations, example[0])


def run(spark: SparkSession, folder: str | None, base: str, settings: Settings = Settings(),
        catalog: DataFrame | None = None, rfcs: DataFrame | None = None,
        keep_archive: bool = True, texts: DataFrame | None = None) -> dict:
    """The whole batch over a folder of tables, over documents, or both. Verdicts are stored before the report is written, and a
    failing archive does not fail the run."""
    started = time.time()
    tune(spark)
    store = warehouse.Warehouse(spark, f"{base}/books")
    counts, translation = load(spark, folder, store, texts)
    books = store.tables()
    if catalog is None:
        catalog = spark.createDataFrame([], schema.SECTOR_CATALOG)
    found = investigate(
        books["entities"], books["blacklist_69b"], books["invoices"], books["invoice_items"],
        books["bank_ledger"], catalog, settings, rfcs)
    rows, skipped = warehouse.case_rows(found.verdicts, books["entities"])
    store.write_cases(rows)
    rows, skipped = store.table("cases"), settle(skipped)      # as stored, and not as planned
    lines = report.case_document(
        found.verdicts, found.evidence, datetime.now().strftime("%Y-%m-%d %H:%M"))
    run_id = failure = None
    if keep_archive:
        try:
            run_id = archive.Archive(spark, f"{base}/archive").save(
                found.verdicts, found.evidence, lines, "plantilla",
                (folder or "documentos").rstrip("/").split("/")[-1])
        except Exception as error:  # the verdicts are already stored
            failure = str(error)
    return {"counts": counts, "translation": translation, "findings": found, "cases": rows,
            "skipped": skipped, "document": lines, "expediente_id": run_id,
            "archive_failure": failure, "summary": report.run_summary(found.verdicts),
            "release": lambda: release(spark),     # once the tables above are no longer read
            "elapsed_seconds": round(time.time() - started, 1)}
