"""Operators: DataFrame -> DataFrame, parameterised by column names; none collects rows."""
