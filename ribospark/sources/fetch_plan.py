"""Which files a data set needs, as URLs and local names, and a plain way to fetch them."""

from __future__ import annotations

import base64
import gzip
import json
import os
import re
import shutil
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from concurrent.futures import ThreadPoolExecutor

# Public servers and the names of their files.
GENOME_SERVER = "ftp://ftp.ensembl.org/pub"
REFSEQ_SERVER = "https://ftp.ncbi.nlm.nih.gov/refseq/H_sapiens/annotation/GRCh38_latest/refseq_identifiers/"
CLINICAL_SERVER = "https://ftp.ncbi.nlm.nih.gov/pub/clinvar/vcf_GRCh38/"
CENSUS_SERVER = "https://cancer.sanger.ac.uk"
STUDY_SERVER = "https://cbioportal-datahub.s3.amazonaws.com"
STUDY_LIST = "https://www.cbioportal.org/api/studies"
SPECIES_LIST = "https://rest.ensembl.org/info/species"
SCHEMES = ("http", "https", "ftp")
REFSEQ_FILES = ("GRCh38_latest_genomic.gtf.gz", "GRCh38_latest_rna.fna.gz", "GRCh38_latest_assembly_report.txt")
CLINICAL_FILES = ("clinvar.vcf.gz", "clinvar.vcf.gz.tbi")
CENSUS_FILES = (("cosmic/file_download/GRCh38/cosmic/v94", "CosmicMutantExport.tsv.gz"), ("cosmic/file_download/GRCh38/cosmic/v94", "All_COSMIC_Genes.fasta.gz"), ("cosmic/file_download/GRCh38/cell_lines/v94", "All_CellLines_Genes.fasta.gz"), ("cosmic/file_download/GRCh38/cell_lines/v94", "CosmicCLP_MutantExport.tsv.gz"))
GENOME_KINDS = {"protein": ("pep", "pep.all.fa.gz"), "cds": ("cds", "cds.all.fa.gz"), "cdna": ("cdna", "cdna.all.fa.gz"), "ncrna": ("ncrna", "ncrna.fa.gz"), "dna": ("dna", "dna_sm.toplevel.fa.gz")}


def genome_files(name: str, assembly: str, release: str | int, kinds: tuple[str, ...] = ("protein", "gtf", "cds", "cdna", "ncrna", "dna", "vcf"), grch37: bool = False, server: str = GENOME_SERVER, per_chromosome: bool = False) -> list[tuple[str, str]]:
    """(url, file name) of a species' files; human variants may be asked for by chromosome."""
    base, out = f"{server}/grch37/release-{release}" if grch37 else f"{server}/release-{release}", []
    build = "GRCh37" if grch37 else assembly
    proper = name[0].upper() + name[1:]
    for kind in kinds:
        if kind in GENOME_KINDS:
            folder, suffix = GENOME_KINDS[kind]
            file = f"{proper}.{build}.{suffix}"
            out.append((f"{base}/fasta/{name}/{folder}/{file}", file))
        elif kind == "gtf":
            file = f"{proper}.{build}.{'87' if grch37 else re.sub('[^0-9]', '', str(release))}.gtf.gz"
            out.append((f"{base}/gtf/{name}/{file}", file))
        elif kind == "vcf":
            parts = [f"-chr{c}" for c in [*range(1, 23), "X", "Y", "MT"]] if per_chromosome else [""]
            for part in parts:
                file = f"{name}_incl_consequences{part}.vcf.gz"
                out.append((f"{server}/release-{release}/variation/vcf/{name}/{file}", file))
        else:
            raise ValueError(f"unknown kind of file {kind}")
    return out


def clinical_files(refseq: str = REFSEQ_SERVER, clinical: str = CLINICAL_SERVER) -> list[tuple[str, str]]:
    return [(refseq + f, f) for f in REFSEQ_FILES] + [(clinical + f, f) for f in CLINICAL_FILES]


def census_files(server: str = CENSUS_SERVER) -> list[tuple[str, str]]:
    return [(f"{server}/{folder}/{file}", file) for folder, file in CENSUS_FILES]


def study_files(studies: list[str], server: str = STUDY_SERVER, listed: str = STUDY_LIST) -> list[tuple[str, str]]:
    """Files of the named studies; ``all`` asks the server which there are."""
    names = study_names(listed) if "all" in studies else studies
    return [(f"{server}/{s}.tar.gz", f"{s}.tar.gz") for s in names]


def _asked(url: str, headers: dict[str, str] | None = None) -> object:
    _allowed(url)
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json", "Content-Type": "application/json"} | (headers or {})), timeout=60) as answer:
        return json.loads(answer.read().decode("utf-8"))


def study_names(listed: str = STUDY_LIST) -> list[str]:
    return [s["studyId"] for s in _asked(listed)]


def species_names(listed: str = SPECIES_LIST) -> list[str]:
    return [s["name"] for s in _asked(listed)["species"]]


def census_url(url: str, user: str, password: str) -> str:
    """The short-lived URL that the census server gives for a file to a known user."""
    token = base64.b64encode(f"{user}:{password}".encode()).decode()
    return _asked(url, {"Authorization": f"Basic {token}"})["url"]


def _allowed(url: str) -> None:
    if urllib.parse.urlparse(url).scheme not in SCHEMES:
        raise ValueError(f"scheme of {url} is not allowed")


class Pace:
    """At most ``most`` requests a second by all threads together."""

    def __init__(self, most: float):
        self.gap, self.next, self.lock = 1 / most, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            self.next = max(now, self.next) + self.gap
            pause = self.next - self.gap - now
        if pause > 0:
            time.sleep(pause)


def fetch(url: str, path: str, tries: int = 6, force: bool = False, pace: Pace | None = None, pause: float = 0.5) -> str | None:
    """Fetch ``url`` to ``path`` (unpacked if gzipped) unless it is there; its final name, or None after ``tries`` failures.

    Between tries it waits ``pause`` seconds, each time twice as long; what the server says
    isn't there or isn't allowed is not asked for again.
    """
    _allowed(url)
    final = path.removesuffix(".gz")
    if os.path.exists(final) and not force:
        return final
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for turn in range(tries):
        if turn:
            time.sleep(pause * 2 ** (turn - 1))
        if pace:
            pace.wait()
        try:
            part = f"{path}.part"
            with urllib.request.urlopen(url, timeout=60) as answer, open(part, "wb") as out:
                shutil.copyfileobj(answer, out)
            if path.endswith(".gz"):
                with gzip.open(part) as packed, open(final, "wb") as out:
                    shutil.copyfileobj(packed, out)
                os.remove(part)
            else:
                os.replace(part, final)
            return final
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code not in (408, 429):
                return None
        except OSError:  # of the network, the server or the archive
            continue
    return None


def fetch_all(files: list[tuple[str, str]], folder: str, force: bool = False, resolve=None, instead=None, threads: int = 10, most: float = 15.0) -> list[tuple[str, str | None]]:
    """(url, where it is now or None) of every file, in order, ``threads`` at a time and at most ``most`` requests a second.

    ``resolve`` may turn a listed URL into the one to read; ``instead`` may name the files that
    take the place of one that can't be had.
    """
    pace = Pace(most)

    def one(file: tuple[str, str]) -> tuple[str, str | None]:
        url, name = file
        return url, fetch(resolve(url) if resolve else url, f"{folder}/{name}", force=force, pace=pace)

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(one, files))
        others = {url: instead(url) for url, path in found if path is None and instead}
        more = dict(pool.map(one, [file for some in others.values() for file in some]))
    return [row for url, path in found for row in ([(u, more[u]) for u, _ in others[url]] if others.get(url) else [(url, path)])]


def by_chromosome(url: str) -> list[tuple[str, str]]:
    """The files by chromosome of a human variant file; none of another."""
    folder, _, file = url.rpartition("/")
    if file != "homo_sapiens_incl_consequences.vcf.gz":
        return []
    return [(f"{folder}/{name}", name) for c in [*range(1, 23), "X", "Y", "MT"] for name in [file.replace(".vcf.gz", f"-chr{c}.vcf.gz")]]


def url_lines(files: list[tuple[str, str]], folder: str) -> list[str]:
    """``url<TAB>file`` lines; only http, https and ftp URLs are allowed."""
    for url, _ in files:
        _allowed(url)
    return [f"{url}\t{folder}/{name}" for url, name in files]
