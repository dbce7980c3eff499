"""Validation, joins, navigation, SQL and Datalog as DataFrame operators."""
