"""Cleaning and analysing purchase transactions with Spark."""

from spendloom.config import CleanConfig
from spendloom.plans.cleaning import clean_and_summarise, clean_transactions

__all__ = ["CleanConfig", "clean_and_summarise", "clean_transactions"]
