"""Oracle SQL for every query of the catalogue."""

from kickstand.plans.oracle_calibration import CALIBRATION
from kickstand.plans.oracle_extracts import EXTRACTS
from kickstand.plans.oracle_insights import INSIGHTS
from kickstand.plans.oracle_measures import MEASURES
from kickstand.plans.oracle_operations import OPERATIONS


def all_oracles():
    return {**EXTRACTS, **CALIBRATION, **OPERATIONS, **MEASURES, **INSIGHTS}
