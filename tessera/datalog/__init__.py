"""The rule language: non-recursive, negation-free Datalog over one base predicate, relation/3."""

from .language import Comparison, DatalogError, Declaration, Literal, Program, Rule, parse_program, stratify, validate

__all__ = ["Comparison", "DatalogError", "Declaration", "Literal", "Program", "Rule", "parse_program", "stratify", "validate"]
