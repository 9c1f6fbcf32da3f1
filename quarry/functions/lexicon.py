"""Fixed rule tables. Labels, order, words and patterns are fixed values that results depend on."""

from __future__ import annotations

# File formats, first match on the lower-case base name.
FILE_FORMATS = (
    (r"\.h5ad(\.gz)?$", "h5ad"),
    (r"filtered_feature_bc_matrix\.h5$", "h5_10x_filtered_feature"),
    (r"raw_feature_bc_matrix\.h5$", "h5_10x_raw_feature"),
    (r"filtered_peak_bc_matrix\.h5$", "h5_10x_filtered_peak"),
    (r"raw_peak_bc_matrix\.h5$", "h5_10x_raw_peak"),
    (r"filtered_tf_bc_matrix\.h5$", "h5_10x_filtered_tf"),
    (r"\.h5$", "h5_generic"),
    (r"matrix\.mtx(\.gz)?$", "mtx_matrix"),
    (r"barcodes\.tsv(\.gz)?$", "mtx_barcodes"),
    (r"(features|genes)\.tsv(\.gz)?$", "mtx_features"),
    (r"fragments\.tsv(\.gz)?$", "fragments"),
    (r"\.loom(\.gz)?$", "loom"),
    (r"\.rds(\.gz)?$", "rds"),
    (r"\.(tar\.gz|tgz|tar)$", "tar"),
    (r"\.(csv|csv\.gz)$", "csv"),
    (r"\.(tsv|tsv\.gz|txt|txt\.gz)$", "tsv"),
)

# Modality signals, first match.
FILE_MODALITIES = (
    (r"(atac|ATAC|chromatin|peak_bc_matrix|peak_matrix|fragments\.tsv|chromVAR)", "atac"),
    (r"(rna|RNA|feature_bc_matrix|gene_bc_matrix|UMI_count|gene_count|gene_expression|spliced|unspliced)", "rna"),
    (r"(multiome|multi.?ome|10x.?arc|joint)", "multiome"),
    (r"(cite|CITE|ADT|HTO|antibody)", "cite"),
)

# Processing levels, first match.
PROCESSING_LEVELS = (
    (r"(filtered|filt_)", "filtered"),
    (r"(raw_feature|raw_peak|raw_tf|RawCount)", "raw"),
    (r"(processed|normalized|log.?count|scaled)", "processed"),
)

# Matrix types by substring, and the modality they imply where no signal was found.
MATRIX_TYPES = (
    ("filtered_feature_bc_matrix", "rna"),
    ("raw_feature_bc_matrix", "rna"),
    ("filtered_peak_bc_matrix", "atac"),
    ("raw_peak_bc_matrix", "atac"),
    ("filtered_tf_bc_matrix", "atac"),
)

# Names that mark a count matrix, and names that rule it out.
COUNT_MATRIX = (r"matrix\.mtx", r"feature_bc_matrix", r"peak_bc_matrix", r"tf_bc_matrix", r"count", r"UMI", r"expression", r"\.h5ad", r"\.h5$", r"\.loom", r"gene_activit", r"peak_matrix")
NOT_COUNT_MATRIX = (r"annotation", r"metadata", r"cell_meta", r"sample_qc", r"filelist\.txt", r"README", r"cell_type", r"cluster_name", r"contig_annotation", r"_qc\.", r"hashtag")

# Formats that convert to a cell-by-gene matrix.
CONVERTIBLE = ("h5ad", "h5_10x_filtered_feature", "h5_10x_raw_feature", "h5_10x_filtered_peak", "h5_10x_raw_peak", "h5_10x_filtered_tf", "h5_generic", "mtx_matrix", "loom", "csv", "tsv")

# Named format filters; None stands for the count-matrix flag.
FORMAT_FILTERS = {
    "filtered_feature_h5": ("h5_10x_filtered_feature",),
    "raw_feature_h5": ("h5_10x_raw_feature",),
    "filtered_peak_h5": ("h5_10x_filtered_peak",),
    "raw_peak_h5": ("h5_10x_raw_peak",),
    "h5ad": ("h5ad",),
    "h5": ("h5_10x_filtered_feature", "h5_10x_raw_feature", "h5_10x_filtered_peak", "h5_10x_raw_peak", "h5_generic"),
    "mtx": ("mtx_matrix", "mtx_barcodes", "mtx_features"),
    "loom": ("loom",),
    "csv": ("csv",),
    "tsv": ("tsv",),
    "fragments": ("fragments",),
    "tar": ("tar",),
    "count_matrix": None,
}

# Names of format flags in a list of available formats.
FORMAT_NAMES = (
    ("has_h5_10x_filtered_feature", "filtered_feature_bc.h5"),
    ("has_h5_10x_raw_feature", "raw_feature_bc.h5"),
    ("has_h5_10x_filtered_peak", "filtered_peak_bc.h5"),
    ("has_h5_10x_raw_peak", "raw_peak_bc.h5"),
    ("has_h5ad", "h5ad"),
    ("has_mtx_triplet", "MTX-triplet"),
    ("has_loom", "loom"),
    ("has_csv_tsv", "csv/tsv"),
    ("has_fragments", "fragments.tsv"),
    ("has_tar", "tar(内含样本)"),
    ("has_rds", "rds(R)"),
)

# Research domains by pattern counts, in the order that breaks ties.
DOMAIN_PATTERNS = {
    "cancer": (
        r"cancer", r"tumor", r"tumour", r"carcinoma", r"melanoma", r"leukemia", r"leukaemia", r"lymphoma", r"glioma", r"glioblastoma", r"neuroblastoma",
        r"sarcoma", r"adenocarcinoma", r"hepatocellular", r"cholangiocarcinoma", r"mesothelioma", r"myeloma", r"neoplasm", r"malignant", r"metasta",
        r"oncogen", r"basal\s*cell", r"squamous\s*cell", r"pancreatic\s*ductal", r"\bCRC\b", r"\bHCC\b", r"\bNSCLC\b", r"\bSCLC\b", r"\bAML\b", r"\bALL\b",
        r"\bCLL\b", r"\bGBM\b", r"\bPDAC\b", r"\bTNBC\b", r"\bRCC\b", r"triple.negative", r"breast\s*cancer", r"lung\s*cancer", r"colon\s*cancer",
        r"colorectal", r"ovarian\s*cancer", r"prostate\s*cancer", r"bladder\s*cancer", r"gastric\s*cancer", r"liver\s*cancer", r"renal\s*cell",
        r"tumor\s*microenvir", r"immune\s*evasion", r"checkpoint",
    ),
    "development": (
        r"develop", r"embryo", r"fetal", r"foetal", r"fetus", r"organogenesis", r"differentiat", r"lineage\s*tracing", r"cell\s*fate", r"progenitor",
        r"stem\s*cell", r"pluripoten", r"iPSC", r"\bESC\b", r"hPSC", r"gastrulat", r"neurulat", r"somitogenesis", r"morphogenesis", r"maturation",
        r"specification", r"commitment", r"reprogramm", r"organoid", r"blastocyst", r"morula", r"zygote", r"implantation", r"hematopoie", r"haematopoie",
        r"erythropoie", r"myogenesis", r"chondrogenesis", r"osteogenesis", r"adipogenesis", r"angiogenesis", r"neurogenesis", r"gliogenesis",
        r"synaptogenesis", r"cell\s*atlas.*fetal", r"fetal.*atlas", r"time.?course", r"pseudo.?time", r"trajectory",
    ),
    "disease": (
        r"alzheimer", r"parkinson", r"huntington", r"ALS\b", r"sclerosis", r"fibrosis", r"cirrhosis", r"hepatitis", r"diabetes", r"obesity", r"asthma",
        r"COPD", r"arthritis", r"lupus", r"autoimmune", r"inflammatory", r"IBD\b", r"crohn", r"colitis", r"COVID", r"infection", r"sepsis", r"pneumonia",
        r"influenza", r"viral", r"injury", r"ischemia", r"infarction", r"stroke", r"trauma", r"neuropathy", r"retinopathy", r"cardiomyopathy",
        r"nephropathy", r"degenerat", r"dysplasia", r"atrophy",
    ),
    "normal": (
        r"normal\s*tissue", r"healthy\s*donor", r"healthy\s*adult", r"homeosta", r"tissue\s*atlas", r"cell\s*atlas", r"reference\s*atlas",
        r"cell\s*census", r"human\s*cell\s*landscape", r"human\s*cell\s*atlas", r"adult\s*tissue", r"normal\s*colon", r"normal\s*brain", r"normal\s*lung",
        r"normal\s*liver", r"normal\s*kidney", r"normal\s*heart", r"steady.?state", r"resting\s*state", r"peripheral\s*blood.*healthy", r"PBMC.*healthy",
    ),
}

# Modalities of a study's text.
TEXT_MODALITIES = {
    "rna": (r"scRNA", r"snRNA", r"single.cell\s*RNA", r"single.nucleus\s*RNA", r"10x\s*(genomics|chromium).*RNA", r"drop.?seq", r"smart.?seq", r"CEL.?seq", r"MARS.?seq", r"inDrop", r"RNA.?seq", r"transcriptom", r"gene\s*expression"),
    "atac": (r"scATAC", r"snATAC", r"single.cell\s*ATAC", r"single.nucleus\s*ATAC", r"chromatin\s*accessib", r"ATAC.?seq", r"open\s*chromatin"),
    "multiome": (r"multiome", r"multi.?ome", r"multi.?modal", r"multi.?omic", r"10x.*ARC", r"joint\s*profiling", r"paired.*RNA.*ATAC", r"simultaneous.*RNA.*ATAC", r"co.?assay"),
    "cite": (r"CITE.?seq", r"REAP.?seq", r"ECCITE", r"antibody.?derived\s*tag", r"surface\s*protein", r"ADT\b", r"protein\s*expression"),
}
EXPRESSION_TYPE = "Expression profiling by high throughput sequencing"
BINDING_TYPE = "Genome binding/occupancy profiling by high throughput sequencing"

# Families of sample characteristics by lower-case key, first family wins.
CHARACTERISTIC_KEYS = {
    "tissue": ("tissue", "tissue type", "organ", "tissue/organ", "cell source", "anatomical site", "body site", "sample source", "tissue source"),
    "disease": ("disease", "disease state", "disease status", "diagnosis", "condition", "pathology", "disease type", "clinical diagnosis", "health status"),
    "cell_type": ("cell type", "cell_type", "celltype", "cell population", "cell lineage", "sorted population", "facs gate"),
    "treatment": ("treatment", "drug", "perturbation", "stimulus", "compound", "intervention", "treated with"),
    "sex": ("sex", "gender"),
    "age": ("age", "age at diagnosis", "age (years)", "donor age"),
    "donor": ("donor", "patient", "subject", "individual", "donor id", "patient id", "subject id"),
}
NO_VALUE = ("na", "n/a", "none", "unknown", "--")
NO_SOURCE = ("na", "n/a", "none", "")

# Modality of a series type, and signals in titles and summaries, in order.
SERIES_TYPES = {
    "expression profiling by high throughput sequencing": "scRNA-seq",
    "non-coding rna profiling by high throughput sequencing": "ncRNA-seq",
    "genome binding/occupancy profiling by high throughput sequencing": "ChIP-seq/ATAC-seq",
    "methylation profiling by high throughput sequencing": "Bisulfite-seq",
    "snp genotyping by high throughput sequencing": "WGS/WES",
    "other": "other",
}
ASSAY_SIGNALS = (
    ("scrna", "scRNA-seq"),
    ("single-cell rna", "scRNA-seq"),
    ("single cell rna", "scRNA-seq"),
    ("10x genomics", "scRNA-seq"),
    ("drop-seq", "scRNA-seq"),
    ("smart-seq", "scRNA-seq"),
    ("scatac", "scATAC-seq"),
    ("single-cell atac", "scATAC-seq"),
    ("single cell atac", "scATAC-seq"),
    ("cite-seq", "CITE-seq"),
    ("multiome", "Multiome"),
    ("spatial transcriptom", "Spatial"),
    ("visium", "Spatial"),
    ("merfish", "Spatial"),
    ("slide-seq", "Spatial"),
)

# Domain by the first group with a word in the text.
DOMAIN_WORDS = (
    ("cancer", ("cancer", "tumor", "tumour", "carcinoma", "lymphoma", "leukemia", "melanoma", "sarcoma", "glioma", "blastoma")),
    ("development", ("development", "embryo", "fetal", "organogenesis", "differentiation")),
    ("immunology", ("immune", "immunity", "inflammation", "autoimmune")),
    ("neurodegeneration", ("neurodegen", "alzheimer", "parkinson")),
    ("infectious_disease", ("covid", "sars-cov")),
)

# Organ by the first entry with a word in the text.
ORGANS = (
    ("lung", ("lung", "pulmonary")),
    ("breast", ("breast", "mammary")),
    ("colon", ("colon", "colorectal", "rectal", "intestine", "intestinal")),
    ("liver", ("liver", "hepatic", "hepatocellular")),
    ("brain", ("brain", "glioma", "glioblastoma", "astrocytoma", "cns")),
    ("pancreas", ("pancreas", "pancreatic")),
    ("gastric", ("gastric", "stomach")),
    ("hematologic", ("leukemia", "lymphoma", "myeloma", "bone marrow", "hematologic", "aml", "cll")),
    ("prostate", ("prostate",)),
    ("ovary", ("ovary", "ovarian")),
    ("kidney", ("kidney", "renal")),
    ("bladder", ("bladder", "urothelial")),
    ("skin", ("skin", "melanoma")),
    ("head_neck", ("head and neck", "head-neck", "hnscc", "nasopharyngeal", "oral squamous")),
    ("esophagus", ("esophagus", "esophageal")),
    ("thyroid", ("thyroid",)),
    ("cervix", ("cervical", "cervix")),
    ("uterus", ("uterine", "endometrial", "endometrium")),
)

# Names that show single-cell files, searched in the joined lower-case names.
SINGLE_CELL = (r"matrix\.mtx", r"barcodes\.tsv", r"features\.tsv", r"genes\.tsv", r"filtered_feature_bc_matrix", r"raw_feature_bc_matrix", r"filtered_gene_bc_matrices", r"\.h5$", r"\.h5ad$", r"\.loom$", r"10[xX]", r"cellranger")

# Common names of organisms; the filter knows the first four.
ORGANISMS = (
    ("human", "Homo sapiens"),
    ("mouse", "Mus musculus"),
    ("rat", "Rattus norvegicus"),
    ("zebrafish", "Danio rerio"),
    ("fly", "Drosophila melanogaster"),
    ("worm", "Caenorhabditis elegans"),
)

# Assays that a plain query names, in order.
QUERY_ASSAYS = (("scatac", "scATAC-seq"), ("cite-seq", "CITE-seq"), ("multiome", "Multiome"), ("spatial", "Spatial"), ("scrna", "scRNA-seq"))

# Ontologies of a field, text limits, and retrieval constants.
FIELD_ONTOLOGIES = {"cell_type": ("CL",), "tissue": ("UBERON",), "disease": ("MONDO",)}
LIMITS = {"summary": 500, "summary_short": 300, "design": 300, "title": 200, "document": 2000, "search_text": 4000, "detail_summary": 1000, "detail_design": 500, "abstract": 800}
RRF_K = 60
TOP_K = 50
RERANK_K = 10

# A leading letter, a stated one and one at the end; a marked number and any; what looks like a function call.
ANSWER_LETTERS = (r"^([A-D])\b", r"(?i)(?:answer|correct)\s*(?:is|:)\s*([A-D])\b", r"\b([A-D])\s*$")
ANSWER_NUMBERS = (r"####\s*([\d,]+\.?\d*)", r"([\d,]+\.?\d*)")
FUNCTION_CALL = r"<functioncall>|<tool_call>|\w+\(.*?\)|\{[\"']name[\"']"

# Modality by words of a file name, first match.
NAME_MODALITIES = (
    ("atac", ("peak_bc_matrix", "atac", "fragments")),
    ("rna", ("feature_bc_matrix", "rna", "gene")),
    ("multiome", ("multiome", "arc")),
)

# Names of the parts of a matrix triplet.
TRIPLET_PARTS = ("matrix.mtx", "barcodes.tsv", "features.tsv", "genes.tsv")

# Download categories by ending; None stands for the parts of a triplet anywhere in the name.
DOWNLOAD_BUCKETS = (
    ("h5ad", (".h5ad", ".h5ad.gz")),
    ("h5", (".h5", ".h5.gz")),
    ("mtx", None),
    ("csv_tsv", (".csv", ".csv.gz", ".tsv", ".tsv.gz", ".txt", ".txt.gz")),
    ("loom", (".loom", ".loom.gz")),
    ("tar", (".tar", ".tar.gz", ".tgz")),
)

# Formats that the converter tells by ending; None stands for a matrix file by its base name.
CONVERTER_FORMATS = (
    ("h5ad", (".h5ad",)),
    ("h5ad_gz", (".h5ad.gz",)),
    ("h5_other", (".h5",)),
    ("mtx", None),
    ("loom", (".loom",)),
    ("tar", (".tar.gz", ".tgz", ".tar")),
    ("mtx", (".mtx.gz",)),
    ("csv", (".csv.gz", ".csv")),
    ("tsv", (".tsv.gz", ".txt.gz", ".tsv", ".txt")),
    ("gz", (".gz",)),
)
