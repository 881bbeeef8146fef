"""The split of a collection of bundles, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagebundle.config import SplitConfig
from pagebundle.operators import documents as dc
from pagebundle.operators import reads as rd
from pagebundle.operators import segments as sg
from pagebundle.operators import verdicts as vd
from pagebundle.operators.tenants import keyed, unkeyed
from pagebundle.staging import stage


@dataclass
class Split:
    """Page decisions plus everything derived from them (all lazy).

    ``keyed``: the page decisions, with the pair of dictionary and bundle as ``bundle_id``
    where pages name dictionaries (operators.tenants). What the properties return then
    has both as columns.
    """

    keyed: DataFrame
    cfg: SplitConfig

    @property
    def states(self) -> DataFrame:
        return unkeyed(self.keyed)

    @property
    def documents(self) -> DataFrame:
        return unkeyed(self._documents())

    @property
    def removed(self) -> DataFrame:
        return unkeyed(self._removed())

    @property
    def signals(self) -> DataFrame:
        return unkeyed(dc.document_signals(self.keyed, self.cfg))

    @property
    def reasons(self) -> DataFrame:
        return unkeyed(dc.review_reasons(self.keyed, self.cfg))

    @property
    def warnings(self) -> DataFrame:
        return unkeyed(dc.bundle_warnings(self.keyed, self._documents(), self.cfg))

    @property
    def summary(self) -> DataFrame:
        return unkeyed(dc.bundle_summary(self.keyed, self._documents()))

    @property
    def records(self) -> DataFrame:
        return unkeyed(self._records())

    @property
    def results(self) -> DataFrame:
        summary = dc.bundle_summary(self.keyed, self._documents())
        return unkeyed(dc.split_results(self._records(), summary, self.cfg))

    def _documents(self) -> DataFrame:
        return dc.documents(self.keyed, self.cfg)

    def _removed(self) -> DataFrame:
        return dc.removed_pages(self.keyed, self._documents(), self.cfg)

    def _records(self) -> DataFrame:
        signals, reasons = dc.document_signals(self.keyed, self.cfg), dc.review_reasons(self.keyed, self.cfg)
        return dc.document_records(self._documents(), signals, reasons, self._removed(), self.cfg)

    def staged(self) -> Split:
        """Write the page decisions once when several results are wanted."""
        return Split(stage(self.keyed, "page_states"), self.cfg)


def split_bundles(
    pages: DataFrame,
    patterns: DataFrame,
    cfg: SplitConfig | None = None,
    ink: DataFrame | None = None,
    ocr: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> Split:
    """pages (bundle_id, page_number, text) -> documents.

    One narrow pass over the texts (the page facts are written, without text),
    then one shuffle on (bundle, page block). Pages with a ``dict_id`` use the patterns of
    that dictionary, and bundles of different dictionaries may share ids; ink, ocr and
    responses without one count for every tenant with such a page.
    """
    cfg = cfg or SplitConfig()
    ink, ocr, responses = (None if df is None else keyed(df, pages) for df in (ink, ocr, responses))
    pages = keyed(pages)
    reads = (
        pages.withColumn("blank", F.lit(False)) if ink is None and ocr is None
        else rd.page_reads(pages, ink, ocr, cfg)
    )
    facts = stage(sg.page_facts(reads, patterns, cfg), "page_facts")
    facts = sg.with_removable(facts, cfg)
    if responses is None:
        return Split(sg.no_verdicts(sg.page_states(facts, cfg)), cfg)
    if cfg.empty_mode == "remove":  # read several times from here on
        facts = stage(facts, "removable_facts")
    judged = vd.judged_verdicts(responses, patterns, cfg)
    return Split(vd.verdict_states(facts, judged, cfg), cfg)
