"""Payroll formulas over employee tables. A row whose inputs break a formula's conditions gets an ``error`` and null amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(ok: Column, message: str, **fields: Column) -> Column:
    fine = F.coalesce(ok, F.lit(False))
    return F.struct(*[F.when(fine, c).alias(k) for k, c in fields.items()], F.when(~fine, F.lit(message)).alias("error"))


def overtime_pay(hourly_wage: Column, hours: Column, day_type: Column, is_night: Column, is_overtime: Column) -> Column:
    """Struct (rate in percent, amount, error). Normal days 150, weekends 200, holidays 300; a night shift 130; overtime at night adds 30 and a fifth of the day's rate."""
    day = F.when(day_type == "weekend", 200.0).when(day_type == "holiday", 300.0).otherwise(150.0)
    night = F.when(is_overtime, day + 30.0 + 0.2 * day).otherwise(130.0)
    rate = F.when(is_night, night).when(is_overtime, day).otherwise(100.0)
    return _checked((hourly_wage > 0) & (hours > 0), "wage and hours must be positive", rate=rate, amount=hourly_wage * (rate / 100.0) * hours)


def rounded_years(months: Column) -> Column:
    """Whole years; a rest of one to six months counts half a year, any other rest a year."""
    rest = months - 12 * F.floor(months / 12)
    return F.floor(months / 12) + F.when(rest == 0, 0.0).when(rest.between(1, 6), 0.5).otherwise(1.0)


def severance(salary: Column, months_worked: Column, months_insured: Column, months_paid: Column, job_loss: Column) -> Column:
    """Struct (years, months of salary, amount, error). Half a month a year; for a lost job a month a year, two at least."""
    years = rounded_years(F.greatest(F.lit(0.0), months_worked - months_insured - months_paid))
    months = F.when(job_loss, F.greatest(F.lit(2.0), years)).otherwise(years * 0.5)
    return _checked((salary > 0) & (months_worked >= 0), "salary must be positive and months not negative", years=years, months=months, amount=salary * months)


def accident_benefit(salary: Column, impairment: Column, own_fault: Column) -> Column:
    """Struct (months of salary, amount, error). 5 to 10 percent 1.5 months, 0.4 more for each further percent, 30 from 81 on; own fault 40 percent of it."""
    base = F.when(impairment >= 81, 30.0).when(impairment <= 10, 1.5).otherwise(1.5 + (impairment - 10) * 0.4)
    months = base * F.when(own_fault, 0.4).otherwise(1.0)
    return _checked((salary > 0) & impairment.between(5, 100), "salary must be positive and impairment 5 to 100", months=months, amount=salary * months)


def unemployment_benefit(salary: Column, months_paid: Column, regional_minimum: Column) -> Column:
    """Struct (monthly, months, amount, error). 60 percent of salary, five regional minima at most; 3 months below 36 paid, one more for each further 12, 12 at most."""
    raw = salary * 0.6
    monthly = F.when(regional_minimum > 0, F.least(raw, regional_minimum * 5.0)).otherwise(raw)
    months = F.when(months_paid < 36, 3).otherwise(F.least(F.lit(12), (3 + F.floor((months_paid - 36) / 12)).cast("int")))
    return _checked((salary > 0) & (months_paid >= 12), "salary must be positive and 12 months paid", monthly=monthly, months=months, amount=monthly * months)
