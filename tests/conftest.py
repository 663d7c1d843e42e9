import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from churnkit.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="churnkit-tests")
    yield s
    s.stop()


def base_row(**over):
    """A valid clean subscriber row (all sentinels consistent); override fields."""
    row = {
        "customerID": "T-1", "gender": "Female", "SeniorCitizen": "No", "Partner": "No", "Dependents": "No",
        "tenure": 24, "PhoneService": "Yes", "MultipleLines": "No", "InternetService": "DSL",
        "OnlineSecurity": "No", "OnlineBackup": "No", "DeviceProtection": "No", "TechSupport": "Yes",
        "StreamingTV": "No", "StreamingMovies": "No", "Contract": "One year", "PaperlessBilling": "No",
        "PaymentMethod": "Mailed check", "MonthlyCharges": 50.0, "TotalCharges": 1200.0, "Churn": 0,
    }
    row.update(over)
    return row


CLEAN_DDL = ("customerID string, gender string, SeniorCitizen string, Partner string, Dependents string, "
             "tenure int, PhoneService string, MultipleLines string, InternetService string, "
             "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
             "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
             "PaymentMethod string, MonthlyCharges double, TotalCharges double, Churn int")


def frame(spark, rows):
    from churnkit.constants import RAW_COLUMNS

    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], CLEAN_DDL)
