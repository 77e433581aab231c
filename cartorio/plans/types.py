"""The document types with an extractor: labels, fields and how each field is read.

A field is a row of this table; new types are added by registering rows, not by writing plans. A type whose fields are
not read by label brings a function of its own, see ``TypeSpec.extract``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldSpec:
    path: str
    reader: str
    labels: tuple[str, ...] = ()
    minimum: int = 2
    kind: str = ""


@dataclass(frozen=True)
class TypeSpec:
    name: str
    version: str
    fields: tuple[FieldSpec, ...]
    other_labels: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    schema_version: int = 1
    block_labels: tuple[str, ...] = ()
    paths: tuple[str, ...] = field(default=())
    #: (lines of this type, today) -> rows (doc_id, path, raw, normalized, status, messages, confidence, page, line_no,
    #: bbox). Columns that are left out are null, messages empty. The best row of a path is that of the smallest ``order``, if it has that column.
    extract: Callable | None = None

    @property
    def known_labels(self) -> list[str]:
        listed = [label for f in self.fields for label in f.labels]
        return list(dict.fromkeys([*listed, *self.block_labels, *self.other_labels]))

    @property
    def all_paths(self) -> list[str]:
        return list(dict.fromkeys([*(f.path for f in self.fields), *self.paths]))


REGISTRY: dict[str, TypeSpec] = {}


def register(spec: TypeSpec) -> TypeSpec:
    REGISTRY[spec.name] = spec
    return spec


def _text(path: str, minimum: int, *labels: str) -> FieldSpec:
    return FieldSpec(path, "TEXT", labels, minimum)


def _date(path: str, kind: str, *labels: str) -> FieldSpec:
    return FieldSpec(path, "DATE", labels, kind=kind)


# Label texts, field paths and versions of the built-in types.
SAMPLE_MARKS = ("AMOSTRA SINTETICA - SEM VALOR LEGAL", "AMOSTRA SINTETICA SEM VALOR LEGAL")

CPF_CARD_LABELS = {
    "cpf": ("NUMERO DE INSCRICAO", "N DE INSCRICAO", "INSCRICAO", "CPF"),
    "name": ("NOME",),
    "birthDate": ("NASCIMENTO", "DATA DE NASCIMENTO"),
}
NOT_BIRTH_MARKERS = ("INSCRICAO EM", "DATA DE INSCRICAO", "EMITIDO EM", "EMISSAO")
CPF_CARD_HEADERS = (
    "REPUBLICA FEDERATIVA DO BRASIL", "MINISTERIO DA FAZENDA", "SECRETARIA DA RECEITA FEDERAL", "CADASTRO DE PESSOAS FISICAS",
    "NUMERO DE INSCRICAO", "NASCIMENTO", "NOME", "AMOSTRA SINTETICA SEM VALOR LEGAL", "INSCRICAO EM",
)
CPF_CARD = register(TypeSpec("BR_CPF_CARD", "br-cpf-card-1.0.0", (), paths=("cpf", "name", "birthDate")))

CIN = register(
    TypeSpec(
        "BR_CIN",
        "br-cin-1.1.0",
        (
            FieldSpec("name", "NAME", ("NOME", "NOME COMPLETO")),
            FieldSpec("cpf", "CPF", ("CPF", "N DO CPF", "NUMERO DO CPF", "NUMERO CPF")),
            FieldSpec("rg", "RG", ("REGISTRO GERAL", "REGISTRO GERAL (RG)", "N DO REGISTRO GERAL", "RG")),
            _date("birthDate", "BIRTH", "DATA DE NASCIMENTO", "DATA NASCIMENTO", "DATA DE NASC", "DATA NASC", "NASCIMENTO"),
            _date("issueDate", "ISSUE", "DATA DE EXPEDICAO", "DATA DA EXPEDICAO", "DATA EXPEDICAO", "EXPEDICAO", "DATA DE EMISSAO", "DATA DA EMISSAO", "DATA EMISSAO"),
            _date("expirationDate", "EXPIRATION", "DATA DE VALIDADE", "VALIDADE"),
            _text("birthPlace", 3, "NATURALIDADE"),
            FieldSpec("fatherName", "NAME", ("NOME DO PAI", "PAI")),
            FieldSpec("motherName", "NAME", ("NOME DA MAE", "MAE")),
        ),
        other_labels=(
            "NOME SOCIAL", "SEXO", "NACIONALIDADE", "ORGAO EMISSOR", "DOC ORIGEM", "DOC. ORIGEM", "ASSINATURA DO TITULAR",
            "NUMERO RIC", "TITULO DE ELEITOR", "NIS", "NIE", "PIS PASEP", "LOCAL", "OBSERVACOES", "UF", "ASSINATURA",
            "IMPRESSAO DIGITAL", "REPUBLICA FEDERATIVA DO BRASIL", "CARTEIRA DE IDENTIDADE", "CARTEIRA DE IDENTIDADE NACIONAL",
            "MINISTERIO DA JUSTICA E SEGURANCA PUBLICA", *SAMPLE_MARKS, "FRENTE", "VERSO",
        ),
        block_labels=("FILIACAO",),
        paths=("mrz",),
    )
)

CNH = register(
    TypeSpec(
        "BR_CNH",
        "br-cnh-1.1.0",
        (
            FieldSpec("name", "NAME", ("NOME", "NOME E SOBRENOME")),
            FieldSpec("cpf", "CPF", ("CPF",)),
            _date("birthDate", "BIRTH", "DATA DE NASCIMENTO", "DATA NASCIMENTO", "DATA NASC", "NASCIMENTO", "DATA, LOCAL E UF DE NASCIMENTO"),
            FieldSpec("registrationNumber", "CNH", ("N REGISTRO", "Nº REGISTRO", "N° REGISTRO", "NO REGISTRO", "NUMERO DE REGISTRO", "N DE REGISTRO", "REGISTRO")),
            FieldSpec("category", "CATEGORY", ("CAT. HAB.", "CAT. HAB", "CAT HAB", "CATEGORIA", "CATEGORIA DE HABILITACAO")),
            _date("firstLicenseDate", "ISSUE", "1A HABILITACAO", "1ª HABILITACAO", "PRIMEIRA HABILITACAO", "1 HABILITACAO", "1A HAB"),
            _date("issueDate", "ISSUE", "DATA EMISSAO", "DATA DE EMISSAO", "EMISSAO"),
            _date("expirationDate", "EXPIRATION", "VALIDADE", "DATA DE VALIDADE"),
        ),
        other_labels=(
            "FILIACAO", "DOC. IDENTIDADE / ORG. EMISSOR / UF", "DOC IDENTIDADE", "ORGAO EMISSOR", "PERMISSAO", "OBSERVACOES", "LOCAL",
            "NACIONALIDADE", "ASSINATURA DO PORTADOR", "ASSINATURA DO EMISSOR", "CHANCELA", "REPUBLICA FEDERATIVA DO BRASIL",
            "MINISTERIO DOS TRANSPORTES", "SECRETARIA NACIONAL DE TRANSITO", "CARTEIRA NACIONAL DE HABILITACAO", *SAMPLE_MARKS,
        ),
    )
)
LICENCE_CATEGORIES = ("A", "B", "C", "D", "E", "AB", "AC", "AD", "AE", "ACC")

PROOF_OF_ADDRESS = register(
    TypeSpec(
        "BR_PROOF_OF_ADDRESS",
        "br-proof-of-address-1.1.0",
        (
            FieldSpec("holderName", "NAME", ("NOME DO CLIENTE", "CLIENTE", "TITULAR", "TITULAR DA CONTA", "DESTINATARIO", "NOME")),
            FieldSpec("holderDocument", "CPF_OR_CNPJ", ("CPF/CNPJ", "CPF / CNPJ", "CPF/CNPJ/RNE", "CNPJ", "CPF")),
            FieldSpec("addressLine", "ADDRESS", ("ENDERECO", "ENDERECO DE ENTREGA", "ENDERECO DO CLIENTE", "ENDERECO DA UNIDADE CONSUMIDORA", "LOGRADOURO")),
            _text("neighborhood", 2, "BAIRRO", "BAIRRO/DISTRITO"),
            _text("city", 3, "MUNICIPIO", "CIDADE"),
            FieldSpec("state", "STATE", ("UF", "ESTADO")),
            FieldSpec("postalCode", "CEP", ("CEP",)),
            FieldSpec("referenceMonth", "MONTH", ("MES DE REFERENCIA", "MES/ANO", "REFERENCIA", "COMPETENCIA", "REF")),
            _date("dueDate", "ANY", "DATA DE VENCIMENTO", "VENCIMENTO"),
        ),
        other_labels=("UNIDADE CONSUMIDORA", "TOTAL A PAGAR", "VALOR", "CONSUMO", "LEITURA ANTERIOR", "LEITURA ATUAL", *SAMPLE_MARKS),
        noise=("NOTA FISCAL", "SERIE", "DATA DE EMISSAO", "CHAVE DE ACESSO", "CODIGO DE BARRAS"),
        paths=("serviceType",),
    )
)
SERVICES = {
    "ELECTRICITY": ("ENERGIA ELETRICA", "KWH", "DISTRIBUIDORA DE ENERGIA"),
    "WATER": ("AGUA E ESGOTO", "ABASTECIMENTO DE AGUA", "SANEAMENTO", "CONSUMO DE AGUA"),
    "GAS": ("GAS NATURAL", "GAS ENCANADO", "DISTRIBUIDORA DE GAS"),
    "TELECOM": ("INTERNET", "BANDA LARGA", "TELEFONIA", "FATURA DE TELEFONE", "TV POR ASSINATURA"),
}

CNPJ_CARD = register(
    TypeSpec(
        "BR_CNPJ_CARD",
        "br-cnpj-card-1.1.0",
        (
            FieldSpec("cnpj", "CNPJ", ("NUMERO DE INSCRICAO", "CNPJ")),
            _date("openingDate", "ISSUE", "DATA DE ABERTURA"),
            _text("legalName", 3, "NOME EMPRESARIAL"),
            _text("tradeName", 2, "TITULO DO ESTABELECIMENTO (NOME DE FANTASIA)", "TITULO DO ESTABELECIMENTO", "NOME DE FANTASIA", "NOME FANTASIA"),
            FieldSpec("mainActivityCode", "ACTIVITY", ("CODIGO E DESCRICAO DA ATIVIDADE ECONOMICA PRINCIPAL", "ATIVIDADE ECONOMICA PRINCIPAL")),
            _text("legalNature", 3, "CODIGO E DESCRICAO DA NATUREZA JURIDICA", "NATUREZA JURIDICA"),
            _text("street", 3, "LOGRADOURO"),
            _text("number", 1, "NUMERO"),
            _text("complement", 1, "COMPLEMENTO"),
            FieldSpec("postalCode", "CEP", ("CEP",)),
            _text("neighborhood", 2, "BAIRRO/DISTRITO", "BAIRRO"),
            _text("city", 2, "MUNICIPIO"),
            FieldSpec("state", "STATE", ("UF",)),
            _text("registrationStatus", 3, "SITUACAO CADASTRAL"),
            _date("registrationStatusDate", "ISSUE", "DATA DA SITUACAO CADASTRAL"),
        ),
        other_labels=(
            "REPUBLICA FEDERATIVA DO BRASIL", "CADASTRO NACIONAL DA PESSOA JURIDICA", "COMPROVANTE DE INSCRICAO E DE SITUACAO CADASTRAL",
            "PORTE", "ENDERECO ELETRONICO", "TELEFONE", "ENTE FEDERATIVO RESPONSAVEL (EFR)",
            "CODIGO E DESCRICAO DAS ATIVIDADES ECONOMICAS SECUNDARIAS", "MOTIVO DE SITUACAO CADASTRAL", "SITUACAO ESPECIAL",
            "DATA DA SITUACAO ESPECIAL", "MATRIZ", "FILIAL", *SAMPLE_MARKS,
        ),
        paths=("mainActivityDescription",),
    )
)

CCMEI = register(
    TypeSpec(
        "BR_CCMEI",
        "br-ccmei-1.1.0",
        (
            FieldSpec("cnpj", "CNPJ", ("NUMERO DO CNPJ", "CNPJ")),
            _text("legalName", 3, "NOME EMPRESARIAL"),
            _text("tradeName", 2, "NOME FANTASIA"),
            _date("openingDate", "ISSUE", "DATA DE ABERTURA", "DATA DE INICIO DE ATIVIDADE"),
            FieldSpec("shareCapital", "MONEY", ("CAPITAL SOCIAL",)),
            FieldSpec("mainActivityCode", "ACTIVITY", ("OCUPACAO PRINCIPAL", "ATIVIDADE ECONOMICA PRINCIPAL", "ATIVIDADE PRINCIPAL")),
            FieldSpec("holderName", "NAME", ("NOME DO EMPRESARIO", "NOME DO TITULAR", "NOME")),
            FieldSpec("holderCpf", "CPF", ("CPF DO EMPRESARIO", "CPF")),
            _date("holderBirthDate", "BIRTH", "DATA DE NASCIMENTO", "NASCIMENTO"),
            _date("certificateDate", "ISSUE", "DATA DE EMISSAO", "EMITIDO EM"),
        ),
        other_labels=(
            "DADOS DO EMPRESARIO", "EMPRESARIO", "FORMA DE ATUACAO", "OCUPACOES SECUNDARIAS", "CCMEI", "PORTAL DO EMPREENDEDOR",
            "CERTIFICADO DA CONDICAO DE MICROEMPREENDEDOR INDIVIDUAL", "REPUBLICA FEDERATIVA DO BRASIL", *SAMPLE_MARKS,
        ),
        block_labels=("ENDERECO COMERCIAL", "ENDERECO"),
        paths=("mainActivityDescription", "address", "postalCode", "city", "state"),
    )
)

SOCIAL_CONTRACT = register(
    TypeSpec(
        "BR_SOCIAL_CONTRACT",
        "br-social-contract-1.0.0",
        (),
        paths=("companyName", "cnpj", "nire", "shareCapital", "headquarters", "headquartersPostalCode", "corporatePurpose", "contractDate"),
    )
)
MAX_PARTNERS = 6
CPF_WINDOW = 400
ANCHOR_REACH = 40
