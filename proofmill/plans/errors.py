"""Everything that a source can be rejected for, as exception classes with named fields.

Two errors are equal if their classes and fields are. The names of classes and fields are part of the interface.
"""

from __future__ import annotations

from typing import Any


class ValidationError(Exception):
    """A source or its data broke a rule."""

    fields: tuple[str, ...] = ()

    def __init__(self, **values: Any):
        if missing := set(self.fields) ^ set(values):
            raise TypeError(f"{type(self).__name__}: fields {sorted(missing)}")
        self.__dict__.update(values)
        super().__init__(f"{type(self).__name__}({', '.join(f'{k}={values[k]!r}' for k in self.fields)})")

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and all(getattr(self, k) == getattr(other, k) for k in self.fields)

    __hash__ = Exception.__hash__


class SourceSyntaxError(ValidationError):
    """The text of a source does not follow the grammar."""

    fields = ("message", "line", "column")


# The names of all errors and of their fields.
CATALOGUE = {
    "TableDefinedTwice": "table_name",
    "TableNameIsNotLowercase": "table_name",
    "DataInsertionsToMaterializedViewsNotAllowed": "table_name",
    "ColumnNameIsNotLowercase": "table_name column_name",
    "ColumnNameIsReserved": "table_name column_name reserved_names",
    "DuplicateColumnNames": "table_name column_name",
    "DuplicateDataColumnNames": "table_name column_name",
    "MoreThanOnePrimaryKey": "table_name",
    "PrimaryKeyColumnMustBeFirst": "table_name column_name",
    "FloatColumnCannotBePrimaryKey": "table_name column_name",
    "BooleanColumnCannotBePrimaryKey": "table_name column_name",
    "FloatColumnCannotBeInUniqueConstraint": "table_name column_name",
    "UniqConstraintColumnDoesntExist": "table_name column_name",
    "DuplicateUniqConstraints": "table_name",
    "UnknownColumnType": "table_name column_name column_type",
    "ForeignKeyTableDoesntExist": "referrer_table referrer_column referred_table",
    "ForeignKeyTableDoesntHavePrimaryKey": "referrer_table referrer_column referred_table",
    "ForeignChildKeyTableDoesntHaveParentTable": "referrer_table referrer_column referred_table",
    "ForeignChildKeyTableIsHigherOrEqualInAncestryThanTheReferrer": "referrer_table referrer_column referred_table",
    "ForeignChildKeyTableIntegerKeyMustBeNonNegative": "referred_table offending_column offending_value",
    "ForeignChildKeyTableStringMustBeAlphanumeric": "referred_table offending_column offending_value",
    "ForeignChildKeyReferrerHasIncorrectSegmentsInCompositeKey": "referrer_table referrer_column referee_table expected_segments actual_segments offending_value",
    "ForeignChildKeyReferrerCannotHaveWhitespaceInSegments": "referrer_table referrer_column referee_table offending_value",
    "ForeignKeyTableDoesNotShareCommonAncestorWithRefereeTable": "referrer_table referrer_column referred_table",
    "InvalidDBIdentifier": "identifier",
    "CannotParseDefaultColumnValue": "table_name column_type column_name the_value",
    "TargetTableForDataNotFound": "table_name",
    "UniqConstraintDuplicateColumn": "table_name column_name",
    "DataTargetColumnNotFound": "table_name target_column_name",
    "DataTooManyColumns": "table_name row_index row_size expected_size",
    "DataTooFewColumns": "table_name row_index row_size expected_size",
    "DataCannotParseDataColumnValue": "table_name row_index column_index column_name column_value expected_type",
    "DataCannotParseDataStructColumnValue": "table_name column_name column_value expected_type",
    "DataRequiredNonDefaultColumnValueNotProvided": "table_name column_name",
    "PrimaryKeysCannotHaveDefaultValue": "table_name column_name",
    "PrimaryOrForeignKeysCannotHaveComputedValue": "table_name column_name",
    "DefaultValueAndComputedValueAreMutuallyExclusive": "table_name column_name",
    "MaterializedViewsCannotHaveDefaultColumnExpression": "table_name column_name",
    "MaterializedViewsCannotHaveComputedColumnExpression": "table_name column_name",
    "ComputedColumnCannotBeExplicitlySpecified": "table_name column_name compute_expression",
    "ExtraDataParentMustHavePrimaryKey": "parent_table",
    "ExtraDataRecursiveInsert": "parent_table extra_table",
    "ExtraDataTableNotFound": "parent_table extra_table",
    "ExtraTableHasNoForeignKeysToThisTable": "parent_table extra_table",
    "ExtraTableMultipleAmbigousForeignKeysToThisTable": "parent_table extra_table column_list",
    "ExtraTableCannotRedefineReferenceKey": "parent_table extra_table column_name",
    "DuplicatePrimaryKey": "table_name value",
    "NonExistingForeignKey": "table_with_foreign_key foreign_key_column referred_table referred_table_column key_value",
    "NonExistingForeignKeyToChildTable": "table_parent_keys table_parent_tables table_parent_columns table_with_foreign_key foreign_key_column referred_table referred_table_column key_value",
    "NonExistingParentToChildKey": "table_parent_keys table_parent_tables table_parent_columns table_with_foreign_key foreign_key_column referred_table referred_table_column key_value",
    "ReferredChildKeyTableIsNotDescendantToThisTable": "referrer_table referrer_column expected_to_be_descendant_table",
    "UniqConstraintViolated": "table_name tuple_definition tuple_value",
    "NonExistingChildPrimaryKeyTable": "table_name column_name referred_table",
    "ParentTableHasNoPrimaryKey": "table_name column_name referred_table",
    "ChildPrimaryKeysLoopDetected": "table_names",
    "ParentPrimaryKeyColumnNameClashesWithChildColumnName": "parent_table parent_column child_table child_column",
    "FoundDuplicateChildPrimaryKeySet": "table_name columns duplicate_values",
    "ParentRecordWithSuchPrimaryKeysDoesntExist": "parent_table parent_columns_names_searched parent_columns_to_find",
    "ExclusiveDataDefinedMultipleTimes": "table_name",
    "DuplicateStructuredDataFields": "table_name duplicated_column",
    "CyclingTablesInContextualInsertsNotAllowed": "table_loop",
    "NanOrInfiniteFloatNumbersAreNotAllowed": "table_name column_name column_value row_index",
    "LuaCheckExpressionLoadError": "table_name expression error",
    "LuaColumnGenerationError": "table_name expression error",
    "LuaColumnGenerationExpressionLoadError": "table_name column_name expression error",
    "LuaColumnGenerationExpressionComputeError": "table_name column_name input_row_fields input_row_values expression error",
    "LuaColumnGenerationExpressionComputeTypeMismatch": "table_name column_name input_row_fields input_row_values computed_value expression error",
    "LuaCheckEvaluationFailed": "table_name expression column_names row_values error",
    "LuaCheckEvaluationErrorUnexpectedReturnType": "table_name expression column_names row_values error",
    "LuaCheckEvaluationError": "table_name expression column_names row_values error",
    "LuaSourcesLoadError": "error source_file",
    "SqlProofTableNotFound": "table_name comment proof_expression",
    "SqlProofQueryError": "error table_name comment proof_expression",
    "SqlProofQueryPlanningError": "error table_name comment proof_expression",
    "SqlProofQueryErrorSingleRowIdColumnExpected": "error table_name comment proof_expression",
    "SqlProofQueryColumnOriginMismatchesExpected": "error expected_column_origin_table expected_column_origin_name actual_column_origin_table actual_column_origin_name comment proof_expression",
    "SqlProofOffendersFound": "table_name comment proof_expression offending_columns",
    "DatalogProofTableNotFound": "table_name comment proof_expression",
    "DatalogProofOutputRuleNotFound": "error table_name comment proof_expression",
    "DatalogProofTooManyOutputRules": "error table_name comment proof_expression",
    "DatalogProofQueryParseError": "error table_name comment proof_expression",
    "DatalogProofNoRulesFound": "error table_name comment proof_expression",
    "DatalogProofBadOutputRuleFormat": "error table_name comment proof_expression",
    "DatalogProofTableExpectedNotFoundInTheOutputQuery": "error table_name comment proof_expression",
    "DatalogProofQueryingFailure": "error table_name comment proof_expression",
    "DatalogProofOffendersFound": "table_name comment proof_expression offending_columns",
    "DatalogIsDisabled": "explanation",
    "SqlMatViewStatementPrepareException": "table_name sql_expression error",
    "SqlMatViewStatementInitException": "table_name sql_expression error",
    "SqlMatViewWrongColumnCount": "table_name sql_expression expected_columns actual_columns",
    "SqlMatViewStatementQueryException": "table_name sql_expression error",
    "SqlMatViewNullReturnsUnsupported": "table_name sql_expression column_name return_row_index",
    "SqlMatViewWrongColumnTypeReturned": "table_name sql_expression column_name return_row_index actual_column_type expected_column_type",
    "FailureReadingExternalFile": "target_file_path error",
    "LuaDataTableError": "error",
    "LuaDataTableInvalidKeyTypeIsNotString": "found_value",
    "LuaDataTableInvalidKeyTypeIsNotValidUtf8String": "lossy_value bytes",
    "LuaDataTableNoSuchTable": "expected_insertion_table",
    "LuaDataTableInvalidTableValue": "found_value",
    "LuaDataTableInvalidRecordValue": "found_value",
    "LuaDataTableInvalidRecordColumnNameValue": "found_value",
    "LuaDataTableRecordInvalidColumnNameUtf8String": "lossy_value bytes",
    "LuaDataTableRecordInvalidColumnValue": "column_name column_value",
    "DetachedDefaultDefinedForColumnAlreadyHavingDefaultValue": "table column hardcoded_default_value detached_default_value",
    "DetachedDefaultUndefined": "table column",
    "DetachedDefaultDefinedMultipleTimes": "table column expression_a expression_b",
    "DetachedDefaultNonExistingTable": "table column expression",
    "DetachedDefaultNonExistingColumn": "table column expression",
    "DetachedDefaultBadValue": "table column value expected_type error",
    "ReplacementsTargetTableDoesntExist": "table",
    "ReplacementsTargetTableDoesntHavePrimaryKey": "table",
    "ReplacementsIsSupportedOnlyByPrimaryKey": "table",
    "ReplacementCannotBeProvidedForGeneratedColumn": "table replacement_primary_key generated_column",
    "ReplacementsDuplicatePrimaryKeyDetected": "table replacement_primary_key",
    "ReplacementsUnexpectedKeySegmentCount": "table replacement_primary_key segments expected_segments segment_separator",
    "ReplacementsCannotReplaceParentPrimaryKey": "table replacement_primary_key parent_primary_key_column",
    "ReplacementsColumnNotFound": "table replacement_primary_key column_not_found available_columns",
    "ReplacementNeverUsed": "table replacement_primary_key replacement_uses replacement_columns replacement_values",
    "ReplacementOverLuaGeneratedValuesIsNotSupported": "table replacement_primary_key",
    "OCamlDataModulePathIsFileAndNotDirectory": "path explanation",
    "OCamlDataModuleExecutionFailed": "path error",
    "OCamlDataModuleExecutionExitCodeNonZero": "path exit_code stdout stderr",
    "OCamlDataModuleNoDataEmitted": "path stdout stderr",
    "OCamlDataModuleCannotParseInput": "path parsing_errpr",
    "OCamlDataModuleTableDoesntExist": "path non_existing_table",
    "OCamlDataModuleBadColumnOutput": "path table row_key row_value explanation",
}

for _name, _fields in CATALOGUE.items():
    globals()[_name] = type(_name, (ValidationError,), {"fields": tuple(_fields.split()), "__module__": __name__})
del _name, _fields
