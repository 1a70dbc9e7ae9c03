"""Registered queries and the SQL that restates them."""

from cohortia.plans import cohort, modelling, problems, tables

REGISTRIES = [problems.REG, cohort.REG, modelling.REG, tables.REG]
flagship = cohort.REG.queries["readmission_30d_by_year_mdc"]
