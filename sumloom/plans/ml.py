"""Pipelines step by step, and as stages of pyspark.ml."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Estimator, Model as MlModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame

from sumloom.operators.prepare import Preparateur
from sumloom.operators.sieves import Sieve
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.plans.pipeline import Model, Pipeline, Slice


class Builder:
    """Adds parts, given as instances or classes, to the current slice; ``cut`` begins a new one,
    ``copycut`` one with the parts of the current. The result of :meth:`build` is a value."""

    def __init__(self, name: str = "pipeline"):
        self.name, self.slices, self.at = name, [Slice()], 0

    def add(self, *parts) -> Builder:
        for p in parts:
            p = p() if isinstance(p, type) else p
            kinds = {Preparateur: "preparateurs", Sieve: "sieves", IteratedSums: "sums", CosineSums: "sums"}
            field = next((f for k, f in kinds.items() if isinstance(p, k)), None)
            if field is None:
                raise TypeError(f"{type(p).__name__} is no part of a slice")
            here = self.slices[self.at]
            self.slices[self.at] = replace(here, **{field: (*getattr(here, field), p)})
        return self

    def clear(self, field: str) -> Builder:
        """Drop the preparateurs, sums or sieves of the current slice."""
        self.slices[self.at] = replace(self.slices[self.at], **{field: ()})
        return self

    def sample(self, size: int | float) -> Builder:
        self.slices[self.at] = replace(self.slices[self.at], fit_sample=size)
        return self

    def cut(self) -> Builder:
        if self.slices[self.at] != Slice():
            self.slices.append(Slice())
            self.at = len(self.slices) - 1
        return self

    def copycut(self) -> Builder:
        self.slices.append(replace(self.slices[self.at]))
        self.at = len(self.slices) - 1
        return self

    def switch(self, i: int) -> Builder:
        self.slices[i]
        self.at = i % len(self.slices)
        return self

    def build(self) -> Pipeline:
        return Pipeline(tuple(self.slices), self.name)


class SeriesFeatures(Estimator):
    """An estimator over packed rows (series_id, x); its model adds a vector column."""

    def __init__(self, pipeline: Pipeline, seed: int = 0, output: str = "features", keep: tuple[str, ...] = ()):
        super().__init__()
        self.pipeline, self.seed, self.output, self.keep = pipeline, seed, output, keep

    def _fit(self, dataset: DataFrame) -> SeriesFeaturesModel:
        return SeriesFeaturesModel(self.pipeline.fit(dataset, self.seed), self.output, self.keep)


class SeriesFeaturesModel(MlModel):
    def __init__(self, model: Model, output: str = "features", keep: tuple[str, ...] = ()):
        super().__init__()
        self.model, self.output, self.keep = model, output, keep

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.model.transform(dataset, list(self.keep))
        return out.withColumn(self.output, array_to_vector("features"))
