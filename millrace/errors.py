"""Exceptions with stable numeric codes."""

from __future__ import annotations


class MillraceError(Exception):
    code = 9999


def _kind(name: str, code: int) -> type[MillraceError]:
    return type(name, (MillraceError,), {"code": code, "__module__": __name__})


# The code of each kind of error.
StorageError = _kind("StorageError", 1000)
NotPrimary = _kind("NotPrimary", 1001)
EngineMissing = _kind("EngineMissing", 1002)
EngineVersion = _kind("EngineVersion", 1003)
EngineMismatch = _kind("EngineMismatch", 1005)
ConfigError = _kind("ConfigError", 1100)
ParseError = _kind("ParseError", 1101)
SqlParseError = _kind("SqlParseError", 1102)
MissingVariable = _kind("MissingVariable", 1103)
TomlError = _kind("TomlError", 1104)
PlaintextPassword = _kind("PlaintextPassword", 1105)
InvalidSecretPath = _kind("InvalidSecretPath", 1106)
IvmUnsupportable = _kind("IvmUnsupportable", 1200)
CycleError = _kind("CycleError", 1201)
InvariantViolation = _kind("InvariantViolation", 1202)
FullRefreshNotAllowed = _kind("FullRefreshNotAllowed", 1203)
MaintenanceWindow = _kind("MaintenanceWindow", 1204)
LockContention = _kind("LockContention", 1300)
LockLost = _kind("LockLost", 1301)
ResumeError = _kind("ResumeError", 1302)
DataLossRequired = _kind("DataLossRequired", 1303)
OwnershipRequired = _kind("OwnershipRequired", 1304)
StalePlan = _kind("StalePlan", 1305)
ImmediateDowngradeRejected = _kind("ImmediateDowngradeRejected", 1306)
UntrustedSql = _kind("UntrustedSql", 1307)
NotYetImplemented = _kind("NotYetImplemented", 1308)
CatalogError = _kind("CatalogError", 1400)
IoError = _kind("IoError", 1500)
JsonError = _kind("JsonError", 1501)
