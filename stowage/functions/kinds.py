"""Kinds of entries, file systems, phases and rights: small fixed tables and the expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of an entry by the type a scan gives it; a regular file is y where contents are encrypted.
TYPE_KINDS = {"regular": "f", "raw": "f", "fifo": "f", "directory": "d", "reparse": "d", "junction": "d", "symlink": "l", "hardlink": "L", "special": "s"}
#: Messages of types that have no entry.
TYPE_ERRORS = {"nofschg": "Will not descend: file system change not allowed", "nofollow": "Could not follow link", "nostat": "Could not stat", "noopen": "Could not open directory"}
#: Magic numbers of file systems, in the order of the numbers.
FILE_SYSTEMS = {
    "devfs": 0x1373, "devpts": 0x1CD1, "smbfs": 0x517B, "nfs": 0x6969, "romfs": 0x7275, "iso9660": 0x9660, "devtmpfs": 0x9FA0, "proc": 0x9FA0,
    "usbdevfs": 0x9FA2, "ext2": 0xEF53, "ext3": 0xEF53, "ext4": 0xEF53, "ecryptfs": 0xF15F, "cgroup": 0x27E0EB, "ceph": 0xC36400, "tmpfs": 0x1021994,
    "zfs": 0x2FC12FC1, "jfs": 0x3153464A, "autofs": 0x42494E4D, "reiserfs": 0x52654973, "ntfs": 0x5346544E, "xfs": 0x58465342, "sysfs": 0x62656572,
    "debugfs": 0x64626720, "fusectl": 0x65735543, "fuse.lxcfs": 0x65735546, "securityfs": 0x73636673, "ramfs": 0x858458F6, "btrfs": 0x9123683E,
    "hugetlbfs": 0x958458F6, "smb2": 0xFE534D42, "cifs": 0xFF534D42,
}
#: What a job does in each of its phases.
PHASE_ACTIONS = {"scanning": "backup", "backup": "backup", "merging": "backup", "shuffling": "backup", "listing": "list", "restoring": "restore", "verifying": "verify", "deleting": "delete", "diffing": "diff"}
RIGHTS = ["delete", "diff", "list", "monitor", "restore", "verify"]


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def entry_kind(kind_of_file: Column, encrypted: bool = False) -> Column:
    """Kind of the entry that a scanned type becomes; null where it becomes a warning."""
    kind = F.element_at(_map(TYPE_KINDS), kind_of_file)
    return F.when(kind == "f", "y").otherwise(kind) if encrypted else kind


def type_warning(kind_of_file: Column, path: Column) -> Column:
    """The warning of a type without an entry; null for the others."""
    said = F.coalesce(F.concat(F.lit("Err: "), F.element_at(_map(TYPE_ERRORS), kind_of_file)), F.concat(F.lit("Err: Unknown file type "), kind_of_file))
    return F.when(F.element_at(_map(TYPE_KINDS), kind_of_file).isNull(), F.concat(said, F.lit(": "), path))


def special_type(kind_of_file: Column, path: Column, block_devices: list[str], fifos: list[str]) -> Column:
    """Type of block devices, fifos and symbolic links by the lists of those that are read: raw, fifo, or as they are.

    A symbolic link in the list of block devices counts as the device it points to.
    """
    listed = lambda names: path.isin(names) if names else F.lit(False)
    out = F.when(kind_of_file.isin("block", "symlink") & listed(block_devices), "raw").when((kind_of_file == "fifo") & listed(fifos), "fifo")
    return out.when(kind_of_file.isin("block", "fifo", "character", "socket"), "special").otherwise(kind_of_file)


def file_system_number(name: Column) -> Column:
    """Magic number of a file system by its name or as 0x...; 0 for unknown names."""
    by_hex = F.conv(F.regexp_extract(name, "^0[xX]([0-9A-Fa-f]+)", 1), 16, 10).try_cast("long")
    return F.when(F.lower(name).startswith("0x"), F.coalesce(by_hex, F.lit(0))).otherwise(F.coalesce(F.element_at(_map(FILE_SYSTEMS), name), F.lit(0)))


def phase_action(phase: Column) -> Column:
    return F.coalesce(F.element_at(_map(PHASE_ACTIONS), phase), F.lit("unknown"))


def printable(kind: Column, payload: Column) -> Column:
    """ "f:0004:text" of a frame with a text payload, "f:0004:(binary data)" of others."""
    size = F.lpad(F.hex(F.octet_length(payload).cast("long")), 4, "0")
    return F.concat(kind, F.lit(":"), size, F.lit(":"), F.when(payload.rlike(r"\A[\x20-\x7e\n]*\z"), payload).otherwise("(binary data)"))


def fake_directory(mode: Column) -> Column:
    """Mode of an ancestor that an entry below it stands for: a directory, with the other bits as they are."""
    return F.when(mode.bitwiseAND(F.lit(0o170000)) == 0o040000, mode).otherwise(mode.bitwiseAND(F.lit(~0o170000)).bitwiseOR(F.lit(0o040000)))


def narrowed(right: str, own: Column, target: Column, access: Column) -> Column:
    """A right of a client that acts for another one: its own as a super client, only shared ones as a restore client.

    Nobody may force a backup of another client; access is "super" or "restore", others have no rights.
    """
    if right == "force_backup":
        return F.lit(False)
    return F.when(access == "super", own).when(access == "restore", own & target).otherwise(F.lit(False))


def longest_extension(names: list[str]) -> int:
    """Characters of the longest of these extensions."""
    return max(map(len, names), default=0)
