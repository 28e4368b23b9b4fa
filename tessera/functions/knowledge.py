"""Lookup tables of cell types and gene sets.

Fixed values: published marker and phase genes; results depend on these names.
One line an entry, its name before the colon.
"""

from __future__ import annotations

#: Marker genes (pbmc).
PBMC = """
CD4+ T cells: CD4 IL7R CCR7 TCF7 LEF1 CD3D CD3E
CD8+ T cells: CD8A CD8B GZMK GZMA CD3D CD3E CCL5
Naive T cells: CCR7 SELL LEF1 TCF7 CD27 CD28
Memory T cells: S100A4 IL7R CD44 GZMK
Regulatory T cells: FOXP3 IL2RA CTLA4 TIGIT IKZF2
NK cells: NKG7 GNLY KLRD1 KLRF1 NCAM1 FCGR3A PRF1
B cells: CD19 MS4A1 CD79A CD79B PAX5 BANK1
Plasma cells: MZB1 SDC1 IGHG1 IGHG2 JCHAIN XBP1
CD14+ Monocytes: CD14 LYZ S100A8 S100A9 VCAN FCN1
CD16+ Monocytes: FCGR3A MS4A7 LST1 CDKN1C
Dendritic cells: FCER1A CST3 CLEC10A CD1C ITGAX
Plasmacytoid DC: IL3RA CLEC4C NRP1 TCF4 IRF7
Megakaryocytes: PPBP PF4 GP9 ITGA2B
Platelets: PPBP PF4 TUBB1 GP1BA
Erythrocytes: HBA1 HBA2 HBB GYPA
"""

#: Marker genes (brain).
BRAIN = """
Excitatory neurons: SLC17A7 CAMK2A SATB2 CUX2 RORB
Inhibitory neurons: GAD1 GAD2 SLC32A1 PVALB SST VIP
Astrocytes: GFAP AQP4 SLC1A2 SLC1A3 ALDH1L1
Oligodendrocytes: MBP MOG MOBP PLP1 MAG
OPCs: PDGFRA CSPG4 OLIG1 OLIG2
Microglia: CX3CR1 P2RY12 TMEM119 AIF1 CSF1R
Endothelial: CLDN5 FLT1 PECAM1 VWF
Pericytes: PDGFRB RGS5 KCNJ8 ABCC9
"""

#: Marker genes (immune).
IMMUNE = """
T cells: CD3D CD3E CD3G TRAC TRBC1 TRBC2
B cells: CD19 MS4A1 CD79A CD79B BANK1
NK cells: NKG7 GNLY KLRD1 NCAM1 FCGR3A
Monocytes: CD14 FCGR3A LYZ S100A8 S100A9
Macrophages: CD68 CD163 MRC1 MSR1 MARCO
Dendritic cells: ITGAX CD1C CLEC9A FCER1A
Neutrophils: FCGR3B CSF3R CXCR2 S100A8 S100A9
Mast cells: KIT TPSAB1 CPA3 MS4A2
Eosinophils: CCR3 SIGLEC8 IL5RA PRG2
Basophils: GATA2 CLC HDC IL4
"""

#: Marker genes (tumor).
TUMOR = """
Epithelial: EPCAM KRT8 KRT18 KRT19 CDH1
Fibroblasts: COL1A1 COL1A2 DCN LUM FAP
Endothelial: PECAM1 VWF CDH5 KDR FLT1
Smooth muscle: ACTA2 MYH11 TAGLN CNN1
Pericytes: RGS5 PDGFRB KCNJ8 ABCC9
T cells: CD3D CD3E CD4 CD8A CD8B
B cells: CD19 MS4A1 CD79A
Myeloid: CD68 CD14 ITGAM LYZ
NK cells: NKG7 GNLY KLRD1
"""

#: S phase genes (Tirosh et al. 2016).
S_PHASE = """
MCM5 PCNA TYMS FEN1 MCM2 MCM4 RRM1 UNG GINS2 MCM6 CDCA7 DTL
PRIM1 UHRF1 MLF1IP HELLS RFC2 RPA2 NASP RAD51AP1 GMNN WDR76 SLBP CCNE2
UBR7 POLD3 MSH2 ATAD2 RAD51 RRM2 CDC45 CDC6 EXO1 TIPIN DSCC1 BLM
CASP8AP2 USP1 CLSPN POLA1 CHAF1B BRIP1 E2F8
""".split()

#: g2m phase genes (Tirosh et al. 2016).
G2M_PHASE = """
HMGB2 CDK1 NUSAP1 UBE2C BIRC5 TPX2 TOP2A NDC80 CKS2 NUF2 CKS1B MKI67
TMPO CENPF TACC3 FAM64A SMC4 CCNB2 CKAP2L CKAP2 AURKB BUB1 KIF11 ANP32E
TUBB4B GTSE1 KIF20B HJURP CDCA3 HN1 CDC20 TTK CDC25C KIF2C RANGAP1 NCAPD2
DLGAP5 CDCA2 CDCA8 ECT2 KIF23 HMMR AURKA PSRC1 ANLN LBR CKAP5 CENPE
CTCF NEK2 G2E3 GAS2L3 CBX5 CENPA
""".split()

#: Built-in gene sets.
GENE_SETS = """
Cell Cycle: CDK1 CDK2 CCNA2 CCNB1 CCNE1 MCM2 MCM3
Apoptosis: BCL2 BAX CASP3 CASP9 TP53 FAS FASLG
Immune Response: IL2 IL6 TNF IFNG CD4 CD8A CD19
Metabolism: GAPDH PKM LDHA HK1 HK2 PFKM ENO1
Ribosome: RPL5 RPL11 RPS6 RPS3 RPL3 RPL4 RPS2
"""


def entries(text: str) -> list[tuple[str, str]]:
    """(name, gene) of every entry, in order."""
    lines = (line.partition(": ") for line in text.strip().split("\n"))
    return [(name, gene) for name, _, genes in lines for gene in genes.split()]


MARKERS = {"pbmc": PBMC, "brain": BRAIN, "immune": IMMUNE, "tumor": TUMOR}
