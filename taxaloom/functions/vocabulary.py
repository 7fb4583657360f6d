"""Closed vocabularies."""

from __future__ import annotations

# Spellings that records must use.
CITATION_MODE = ("Auto", "Manual")
CURATION_STATE = ("Complete", "Incomplete")
REVIEW_STATE = ("Reviewed", "Incorrect")
DIRECTION = ("increased", "decreased")
ALPHA_CHANGE = ("increased", "decreased", "unchanged")
STUDY_DESIGN = (
    "case-control",
    "cross-sectional observational, not case-control",
    "time series / longitudinal observational",
    "laboratory experiment",
    "randomized controlled trial",
    "prospective cohort",
    "meta-analysis",
)
SEQUENCING_TYPE = ("16S", "18S", "WMS", "ITS / ITS2", "PCR")
REGION = tuple("123456789")
DATA_TRANSFORMATION = ("raw counts", "relative abundances", "centered log-ratio", "arcsine square-root", "log transformation", "additive log-ratio")
PLATFORM = (
    "DNA-DNA Hybridization", "Human Intestinal Tract Chip", "Illumina", "Ion Torrent", "Mass spectrometry", "Non-quantitative PCR",
    "PacBio Vega (VS)/Revio (RS)/Sequel II", "PhyloChip", "Roche454", "RT-qPCR", "Sanger", "Nanopore", "BGISEQ-500 Sequencing",
    "DNBSEQ-G400", "DNBSEQ-T7", "MGISEQ-2000", "HTF-Microbi.Array", "2b-RAD",
)
STATISTICAL_TEST = (
    "ANCOM", "ANCOM-BC", "ANCOM-BC2", "ANOSIM", "ANOVA", "Beta Binomial Regression", "Chi-Square", "Cox Proportional-Hazards Regression",
    "Decision Trees (xgBoost, gradient boosting)", "distance-based redundancy analysis (db-RDA)", "Dunn's test", "Dunnett's test", "DESeq2",
    "edgeR", "Fisher's Exact Test", "Fold-change cutoff", "G-test", "Jonckheere's trend test", "Kolmogorov-Smirnov Test", "Kruskall-Wallis",
    "LASSO Regression", "LEfSe", "Linear Discriminant Analysis", "Linear Regression", "Logistic Regression", "Mann-Whitney (Wilcoxon)",
    "MaAsLin2", "MaAsLin3", "metagenomeSeq", "Meta-Analysis", "Metastats", "Mixed-Effects Regression", "Negative Binomial Regression",
    "NLMIXED", "Pearson Correlation", "PERMANOVA", "Permutation Test", "PLS-DA (Partial least square discriminant analysis)",
    "Post-Hoc Pairwise", "Random Forest Analysis", "Songbird", "Sparse Correlations for Compositional data (SparCC)", "Spearman Correlation",
    "Structural Equation Modeling (SEM)", "T-Test", "treeDA", "Wald Test", "Welch's T-Test", "Zero-Inflated Beta Regression",
    "Zero-Inflated Negative Binomial Regression",
)
QUALITY_TAG = ("Retracted paper", "Contamination issues suspected", "Batch effect issues suspected", "Uncontrolled confounding suspected", "Results are suspect (various reasons)")
RANKS = {"k": "kingdom", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
