"""Relational feature synthesis and data preparation on Spark."""

from rootstock.api import FeatureConfig, FeaturePipeline, compute_features, feature_engine, get_engine, plan_features
from rootstock.functions.primitives import get_primitive, register_primitive
from rootstock.logging_config import configure_file_logging, configure_logging
from rootstock.operators.transforms import (
    CanonicalizeTypes,
    ColumnTransform,
    FeaturizeDatetime,
    FillMissingPrimaryKey,
    FilterColumn,
    HandleDummyTable,
    InferSchemaTransform,
    RdbTransform,
    RdbTransformPipeline,
    RdbTransformWrapper,
    TableTransform,
    apply_transform,
    apply_transform_pipeline,
)
from rootstock.rdb import Rdb, create_rdb, load_rdb
from rootstock.schema import ColumnSchema, ColumnType, RdbMeta, Relationship, TableFormat, TableSchema
from rootstock.sources.catalogue import load_by_name

__all__ = [
    "CanonicalizeTypes", "ColumnSchema", "ColumnTransform", "ColumnType", "FeatureConfig", "FeaturePipeline", "FeaturizeDatetime", "FillMissingPrimaryKey", "FilterColumn", "HandleDummyTable", "InferSchemaTransform",
    "Rdb", "RdbMeta", "RdbTransform", "RdbTransformPipeline", "RdbTransformWrapper", "Relationship", "TableFormat", "TableSchema", "TableTransform", "apply_transform", "apply_transform_pipeline", "compute_features",
    "configure_file_logging", "configure_logging", "create_rdb", "feature_engine", "get_engine", "get_primitive", "load_by_name", "load_rdb", "plan_features", "register_primitive",
]
